"""Seams for language models: pending work, guided calls in partitions, citation mapping, agentic retrieval."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.plans.shipping import ship_package
from tracewright.plans.storage import materialize

#: Takes a prompt, returns JSON text.
Model = Callable[[str], str]


def echo_model(prompt: str) -> str:
    """A deterministic stand-in: one statement, the prompt's last line."""
    line = prompt.rstrip().rsplit("\n", 1)[-1].strip()
    return json.dumps({"items": [{"text": line}] if line else []})


@dataclass(frozen=True)
class Task:
    """A guided call: instructions, the items its reply lists, and the decoding regime. Its identity is that of all of them."""

    name: str
    instructions: str
    items: str
    version: int = 1
    model: str = "stand-in"
    temperature: float = 0.0
    samples: int = 1

    @property
    def reply(self) -> T.StructType:
        return T.StructType([T.StructField("items", T.ArrayType(T.StructType.fromDDL(self.items)))])

    @property
    def prompt_sha(self) -> str:
        return hashlib.sha256(self.instructions.encode()).hexdigest()

    @property
    def schema_sha(self) -> str:
        return hashlib.sha256(json.dumps(self.reply.jsonValue(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    @property
    def sampling(self) -> dict:
        return {"temperature": self.temperature} | ({"n_samples": self.samples} if self.samples > 1 else {})

    @property
    def signature(self) -> str:
        """What a stored answer depends on: a reworded instruction or a changed schema is another signature."""
        parts = {"model": self.model, "prompt_sha": self.prompt_sha, "sampling": self.sampling, "schema_sha": self.schema_sha, "schema_version": self.version}
        return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def prompt(self, **parts: Column) -> Column:
        """The instructions, then each named part under its name in capitals."""
        said = [F.lit(f"TASK: {self.name}\n{self.instructions}")]
        for name, text in parts.items():
            said += [F.lit(f"\n\n{name.upper()}:\n"), F.coalesce(text, F.lit(""))]
        return F.concat(*said)


def parts_of(prompt: str) -> tuple[str, dict[str, str]]:
    """A task's name and the named parts of a prompt that :meth:`Task.prompt` made."""
    head, *rest = re.split(r"\n\n([A-Z]+):\n", prompt)
    return head.partition("\n")[0].removeprefix("TASK: "), dict(zip(rest[::2], rest[1::2]))


PROPOSE = Task(
    "propose", "List every claim that TARGET makes as one self-contained statement. Resolve references with CONTEXT, which itself is not to be listed. State denied claims "
    "affirmatively and mark them negated. List nothing where nothing is claimed.",
    "text string, polarity string, modality string, attribution string, scope string, epistemic_class string",
)
VERIFY = Task(
    "verify", "Judge CLAIM by SOURCE alone: is it entailed, contradicted or neither (neutral), and does the source bear its polarity and its modality?",
    "entailment string, polarity_preserved boolean, modality_preserved boolean, attribution_preserved boolean",
)
ENTITIES = Task(
    "entities", "List the actors and objects that STATEMENT names, each with its type, kind and role. List nothing that it does not name.", "label string, type string, kind string, role string",
)
MENTIONS = Task("mentions", "List the expressions in STATEMENT that refer to some entity: pronouns, definite descriptions and names.", "surface string, mention_type string, kind string")
PARTS = Task("parts", "List what STATEMENT says is part of something: the part, the whole and the kind of meronymy.", "child string, parent string, meronymy string")
JUDGE = Task("judge", "For each numbered line of EVIDENCE say whether it supports HYPOTHESIS, refutes it or is irrelevant to it. Give the number and the sign only.", "ref int, sign string")


def stand_in(prompt: str) -> str:
    """A deterministic stand-in for all tasks, by rules of spelling that SQL can state too.

    Claims are what full stops part; a prefix un- or in- negates and a comma makes a judgement. Claims of up
    to 100 characters are entailed. Words of eight letters and more are entities, of which the first is the
    subject, and actors up to m; the first two are part and whole. Evidence supports a hypothesis that it
    shares a word with, and refutes it where just one of both is negated.
    """
    name, part = parts_of(prompt)
    negated = lambda text: bool(re.search(r"(^|[^a-z])(un|in)", text.lower()))
    words = lambda text: re.findall(r"[a-z]{8,}", text.lower())
    items: list[dict] = []
    if name == "propose":
        for text in (x.strip(" \n") for x in re.split(r"[.!?][ \n]+", part["TARGET"])):
            if text:
                kind = "judgement" if "," in text else "observation"
                items.append({"text": text, "polarity": "negated" if negated(text) else "asserted", "modality": "categorical", "attribution": "document", "scope": "", "epistemic_class": kind})
    elif name == "verify":
        text = part["CLAIM"]
        items.append({"entailment": "entailed" if len(text) <= 100 else "neutral", "polarity_preserved": True, "modality_preserved": "ly" not in text, "attribution_preserved": True})
    elif name == "entities":
        for k, word in enumerate(dict.fromkeys(words(part["STATEMENT"]))):
            items.append({"label": word, "type": word[:2], "kind": "actor" if word[0] <= "m" else "object", "role": "object" if k else "subject"})
    elif name == "mentions":
        items += [{"surface": word, "mention_type": "definite", "kind": None} for word in dict.fromkeys(words(part["STATEMENT"]))]
    elif name == "parts":
        found = list(dict.fromkeys(words(part["STATEMENT"])))
        items += [{"child": found[0], "parent": found[1], "meronymy": "component-integral"}] if len(found) > 1 else []
    elif name == "judge":
        asked = set(words(part["HYPOTHESIS"]))
        for line in part["EVIDENCE"].split("\n"):
            number, _, text = line.partition(". ")
            shared, apart = asked & set(words(text)), negated(text) != negated(part["HYPOTHESIS"])
            items.append({"ref": int(number), "sign": "irrelevant" if not shared else "refutes" if apart else "supports"})
    return json.dumps({"items": items})


def guided_calls(rows: DataFrame, prompt: str, reply: T.DataType, model: Model = echo_model, attempts: int = 5) -> DataFrame:
    """Adds ``reply`` (parsed to its schema) and ``failure``; a failing row fails alone, after ``attempts``."""
    ship_package(rows.sparkSession)
    out = T.StructType([*rows.schema.fields, T.StructField("__raw", T.StringType()), T.StructField("failure", T.StringType())])

    def run(frames):
        for pdf in frames:
            raw, failed = [], []
            for text in pdf[prompt]:
                answer = error = None
                for _ in range(attempts):
                    try:
                        answer, error = model(text), None
                        json.loads(answer)
                        break
                    except Exception as e:  # noqa: BLE001
                        answer, error = None, f"{type(e).__name__}: {e}"
                raw.append(answer)
                failed.append(error)
            yield pdf.assign(__raw=raw, failure=failed)

    called = rows.mapInPandas(run, out)
    return called.withColumn("reply", F.from_json("__raw", reply)).drop("__raw")


def cite(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(question, chunk)`` of ``(question, cited array<int>)``: 1-based numbers of ``(question, number, chunk)``, in range, each once."""
    numbers = answers.select("question", F.explode(F.array_distinct("cited")).alias("number"))
    return numbers.join(chunks, ["question", "number"]).select("question", "chunk")


def ask(rows: DataFrame, task: Task, prompt: Column, model: Model = stand_in) -> tuple[DataFrame, DataFrame]:
    """Written rows with the ``items`` that ``task`` was answered by, and those whose call failed with ``failure``.

    Each call is made once and each failing row fails alone.
    """
    called = guided_calls(rows.withColumn("__prompt", prompt), "__prompt", task.reply, model).drop("__prompt")
    called = materialize(called, f"asked-{task.name}")
    return called.where("failure is null").select(*rows.columns, F.coalesce("reply.items", F.array().cast(called.schema["reply"].dataType["items"].dataType)).alias("items")), called.where("failure is not null").select(*rows.columns, "failure")


@dataclass
class Search:
    """Outcome of an agentic search: the answer or none, the queries asked and the chunks seen."""

    answer: str | None
    queries: list[str] = field(default_factory=list)
    seen: list = field(default_factory=list)


def agentic_search(question: str, decide: Callable[[str, list], dict], retrieve: Callable[[str], list], max_steps: int = 6) -> Search:
    """Ask for the next step until it answers; repeated chunks are pooled once, a malformed step ends unanswered."""
    out = Search(None)
    for _ in range(max_steps):
        step = decide(question, out.seen)
        if not isinstance(step, dict) or not ({"answer", "query"} & step.keys()):
            return out
        if "answer" in step:
            out.answer = step["answer"]
            return out
        out.queries.append(step["query"])
        out.seen += [c for c in dict.fromkeys(retrieve(step["query"])) if c not in out.seen]
    return out


QUESTION_SCHEMA = "id string, text string, axis string"
ANSWER_SCHEMA = "question_id string, answer_text string, cited_chunk_ids array<string>, confidence double"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    raw = tomllib.loads(spark.read.text(path, wholetext=True).first()[0])
    return spark.createDataFrame([(q["id"], q["text"], q.get("axis")) for q in raw.get("question", [])], QUESTION_SCHEMA)


def write_answers(answers: DataFrame) -> str:
    """TOML of an evaluation's answers, whose number is that of its questions."""
    parts = []
    for r in answers.orderBy("question_id").toLocalIterator():
        cited = ", ".join(json.dumps(c) for c in r["cited_chunk_ids"] or [])
        parts.append(
            f"[[answer]]\nquestion_id = {json.dumps(r['question_id'])}\nanswer_text = {json.dumps(r['answer_text'])}\n"
            f"cited_chunk_ids = [{cited}]\nconfidence = {r['confidence']!r}\n"
        )
    return "\n".join(parts)


def read_answers(spark: SparkSession, text: str) -> DataFrame:
    rows = [(a["question_id"], a["answer_text"], a["cited_chunk_ids"], float(a["confidence"])) for a in tomllib.loads(text).get("answer", [])]
    return spark.createDataFrame(rows, ANSWER_SCHEMA)
