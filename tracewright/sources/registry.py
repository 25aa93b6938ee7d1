"""Boxes and domain packs: registries with lifecycles, read from tables and JSON files."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.plans import fixpoint as X
from tracewright.sources.documents import box_id

TIERS = ("case", "working", "reference", "domain")
MERONYMY = ("component-integral", "member-collection", "portion-mass", "stuff-object", "feature-activity", "place-area")


@dataclass(frozen=True)
class Box:
    """A unit of lifecycle, provenance and tenancy."""

    name: str
    tier: str
    source: str = ""
    version: str = "1"
    status: str = "active"
    reliability_prior: float = 1.0
    interest_role: str | None = None
    interest_stake: str | None = None
    compartments: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.tier not in TIERS:
            raise ValueError(f"unknown tier {self.tier}")
        if not 0 <= self.reliability_prior <= 1:
            raise ValueError("reliability prior outside 0..1")

    @property
    def id(self) -> str:
        return box_id(f"{self.name}@{self.version}")

    def to_props(self, **extra) -> dict:
        return {**asdict(self), "id": self.id, "compartments": json.dumps(list(self.compartments)), **extra}

    @classmethod
    def from_props(cls, props: dict) -> Box:
        held = props.get("compartments") or ()
        held = json.loads(held) if isinstance(held, str) else held
        names = cls.__dataclass_fields__
        return cls(**{k: v for k, v in props.items() if k in names and k != "compartments"}, compartments=tuple(held))


def case_box(name: str, **kw) -> Box:
    return Box(name, "case", **kw)


def working_box(name: str, **kw) -> Box:
    return Box(name, "working", **kw)


def reference_box(name: str, **kw) -> Box:
    return Box(name, "reference", **kw)


BOX_SCHEMA = (
    "id string, name string, tier string, source string, version string, status string, reliability_prior double, interest_role string, "
    "interest_stake string, compartments string"
)


def create_boxes(registry: DataFrame, boxes: list[Box]) -> DataFrame:
    """The registry with boxes it lacks; existing ids stay as they are."""
    rows = registry.sparkSession.createDataFrame([{k.split()[0]: b.to_props()[k.split()[0]] for k in BOX_SCHEMA.split(", ")} for b in boxes], BOX_SCHEMA)
    return registry.unionByName(rows.join(registry.select("id"), "id", "left_anti"), allowMissingColumns=True)


def list_boxes(registry: DataFrame, tiers: list[str] | None = None, active_only: bool = False) -> DataFrame:
    """Boxes by reliability prior, best first."""
    out = registry if tiers is None else registry.where(F.col("tier").isin(*tiers))
    return (out.where("status = 'active'") if active_only else out).orderBy(F.desc("reliability_prior"), out.columns[0])


def deprecate(registry: DataFrame, key: str, value: object) -> DataFrame:
    return registry.withColumn("status", F.when(F.col(key) == value, "deprecated").otherwise(F.col("status")))


@dataclass(frozen=True)
class Pack:
    """A domain pack: entity types, entities and part-of relations, immutable for a name and version."""

    name: str
    version: str
    tier: str = "domain"
    source: str = ""
    reliability_prior: float = 1.0
    description: str = ""
    entity_types: list[dict] = field(default_factory=list)
    entities: list[dict] = field(default_factory=list)
    part_of: list[dict] = field(default_factory=list)

    @classmethod
    def from_dict(cls, raw: dict) -> Pack:
        pack = cls(**{k: raw[k] for k in raw if k in cls.__dataclass_fields__})
        faults = pack.faults()
        if faults:
            raise ValueError("; ".join(faults))
        return pack

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> Pack:
        """A JSON file on any store that Spark reads; a pack is a small hand-made file."""
        return cls.from_dict(json.loads(spark.read.text(path, wholetext=True).first()[0]))

    def faults(self) -> list[str]:
        types, keys = {t["name"] for t in self.entity_types}, [e["key"] for e in self.entities]
        out = [f"entity key {k} repeats" for k in sorted({k for k in keys if keys.count(k) > 1})]
        out += [f"type {t['name']} has an unknown parent" for t in self.entity_types if t.get("parent") and t["parent"] not in types]
        out += [f"entity {e['key']} has an unknown type" for e in self.entities if e["type"] not in types]
        for r in self.part_of:
            out += [f"relation names unknown entity {r[side]}" for side in ("part", "whole") if r[side] not in keys]
            if r.get("meronymy", MERONYMY[0]) not in MERONYMY:
                out.append(f"unknown meronymy {r['meronymy']}")
        return out

    @property
    def content_hash(self) -> str:
        import hashlib

        ordered = asdict(self) | {k: sorted(getattr(self, k), key=lambda x: json.dumps(x, sort_keys=True)) for k in ("entity_types", "entities", "part_of")}
        return hashlib.sha256(json.dumps(ordered, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def edges(self, spark: SparkSession) -> DataFrame:
        rows = [(r["part"], r["whole"], r.get("meronymy", MERONYMY[0])) for r in self.part_of]
        return spark.createDataFrame(rows, "part string, whole string, meronymy string")

    def closure(self, spark: SparkSession) -> DataFrame:
        edges = self.edges(spark)
        if X.has_cycle(edges):
            raise ValueError("part-of relations form a cycle")
        return X.pack_closure(edges)


PACK_SCHEMA = "name string, version string, content_hash string, status string, valid_from timestamp, valid_to timestamp"


def load_pack(packs: DataFrame, pack: Pack, valid_from: Column) -> DataFrame:
    """The registry of packs with this one; the same name and version with other content is an error."""
    held = packs.where((F.col("name") == pack.name) & (F.col("version") == pack.version)).first()
    if held is not None:
        if held["content_hash"] != pack.content_hash:
            raise ValueError(f"pack {pack.name} {pack.version} is already loaded with other content")
        return packs
    row = packs.sparkSession.createDataFrame([(pack.name, pack.version, pack.content_hash, "active")], "name string, version string, content_hash string, status string")
    return packs.unionByName(row.withColumns({"valid_from": valid_from, "valid_to": F.lit(None).cast("timestamp")}))


@dataclass(frozen=True)
class LoadedPack:
    """The registry, and what the load adds to the graph: nothing where the pack was there already."""

    packs: DataFrame
    boxes: DataFrame
    entities: DataFrame
    edges: DataFrame
    actions: DataFrame


EDGE_SCHEMA = "src string, dst string, etype string, box string, meronymy string, anchored string, valid_from timestamp"


def pack_to_graph(packs: DataFrame, pack: Pack, valid_from: Column) -> LoadedPack:
    """Load a pack: its box, entities, direct part-of edges and their closure, stamped once.

    The same name and version with the same content adds nothing, so its stamp never moves; other content is
    an error. A pack is a small hand-made file; its rows come from the driver, its closure from a plan.
    """
    spark = packs.sparkSession
    known = packs.where((F.col("name") == pack.name) & (F.col("version") == pack.version)).limit(1).count() > 0
    registry = load_pack(packs, pack, valid_from)
    box = Box(pack.name, pack.tier, pack.source, pack.version, reliability_prior=pack.reliability_prior)
    boxes = create_boxes(spark.createDataFrame([], BOX_SCHEMA), [box]).withColumns({"content_hash": F.lit(pack.content_hash), "entity_types": F.lit(json.dumps(pack.entity_types, sort_keys=True))})
    rows = [(e["key"], e["label"], e["type"]) for e in pack.entities]
    entities = entity_ids(pack, spark.createDataFrame(rows, "key string, label string, type string")).withColumn("box", F.lit(box.id))
    edges = part_of_edges(pack.edges(spark), entities.select("key", "id"), F.lit(box.id), valid_from)
    actions = spark.createDataFrame([("pack-loader", "create-box", box.id)], "actor string, action_type string, box string")
    if known:
        boxes, entities, edges, actions = (df.where("false") for df in (boxes, entities, edges, actions))
    return LoadedPack(registry, boxes, entities.select("id", "box", "label", "type"), edges, actions)


def part_of_edges(edges: DataFrame, ids: DataFrame, box: Column, valid_from: Column) -> DataFrame:
    """Direct edges ``(part, whole, meronymy)`` by key, and their closure, as graph edges between ``ids(key, id)``."""
    if X.has_cycle(edges):
        raise ValueError("part-of relations form a cycle")
    closed = X.pack_closure(edges)
    direct = closed.where("anchored = 'direct'").withColumn("etype", F.lit("DIRECT_PART_OF"))
    every = direct.unionByName(closed.withColumn("etype", F.lit("PART_OF")))
    named = every.join(ids.select(F.col("key").alias("part"), F.col("id").alias("src")), "part").join(ids.select(F.col("key").alias("whole"), F.col("id").alias("dst")), "whole")
    return named.select("src", "dst", "etype", box.alias("box"), "meronymy", "anchored", valid_from.alias("valid_from"))


def same_as_edges(pairs: DataFrame, box: Column, valid_from: Column) -> DataFrame:
    """SAME_AS edges of resolved ``(a, b, score, state)``, from the lesser id to the greater."""
    ends = [F.least("a", "b").cast("string").alias("src"), F.greatest("a", "b").cast("string").alias("dst")]
    return pairs.select(*ends, F.lit("SAME_AS").alias("etype"), box.alias("box"), "state", F.col("score").alias("strength"), valid_from.alias("valid_from"))


def anchor_edges(anchors: DataFrame, box: Column, valid_from: Column) -> DataFrame:
    """ANCHORS_TO edges of decided ``(mention, target, score, state)``."""
    ends = [F.col("mention").cast("string").alias("src"), F.col("target").cast("string").alias("dst")]
    return anchors.select(*ends, F.lit("ANCHORS_TO").alias("etype"), box.alias("box"), "state", F.col("score").alias("strength"), valid_from.alias("valid_from"))


def rebuild_closure(edges: DataFrame, changed: DataFrame, valid_from: Column) -> DataFrame:
    """All edges with the PART_OF edges of boxes ``changed(box)`` made anew from their direct ones; other boxes keep theirs.

    Boxes are closed in one plan, their nodes told apart by box; edges on or below a cycle stay out.
    """
    direct = edges.where("etype = 'DIRECT_PART_OF'").join(changed.select("box").distinct(), "box", "left_semi")
    end = lambda c: F.to_json(F.struct("box", F.col(c).alias("id")))
    keyed = direct.select(end("src").alias("part"), end("dst").alias("whole"), "meronymy")
    paths = X.part_whole_closure(keyed)
    back = lambda c: F.from_json(c, "box string, id string")
    made = paths.select(
        back("part")["id"].alias("src"), back("whole")["id"].alias("dst"), F.lit("PART_OF").alias("etype"), back("part")["box"].alias("box"), F.lit(MERONYMY[0]).alias("meronymy"),
        F.when(F.col("depth") == 1, "direct").otherwise("rollup").alias("anchored"), valid_from.alias("valid_from"),
    )
    kept = edges.where("etype <> 'PART_OF'").unionByName(edges.where("etype = 'PART_OF'").join(changed.select("box").distinct(), "box", "left_anti"))
    return kept.unionByName(made)


def resolve_tier(box_tier: Column, override: Column | None = None) -> Column:
    """A node's tier: its own where given, else its box's; an unknown one is an error."""
    tier = box_tier if override is None else F.coalesce(override, box_tier)
    return F.when(tier.isin(*TIERS), tier).otherwise(F.raise_error(F.concat(F.lit("unknown tier "), tier)).cast("string"))


def active_packs(packs: DataFrame) -> DataFrame:
    return packs.where("status = 'active' and valid_to is null")


def deprecate_pack(packs: DataFrame, name: str, version: str, at: Column) -> DataFrame:
    hit = (F.col("name") == name) & (F.col("version") == version) & F.col("valid_to").isNull()
    return packs.withColumns({"status": F.when(hit, "deprecated").otherwise(F.col("status")), "valid_to": F.when(hit, at).otherwise(F.col("valid_to"))})


def entity_ids(pack: Pack, entities: DataFrame) -> DataFrame:
    """Deterministic ids of pack entities ``(key)``."""
    return entities.withColumn("id", S.uuid5(F.concat(F.lit(f"{pack.name}@{pack.version}:"), F.col("key"))))


def sample_graph(spark: SparkSession, vertices: int, box_count: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """A synthetic property graph for benchmarks: vertices with boxes and validity, and edges of near-linear chains."""
    nodes = spark.range(vertices).select(
        "id", (F.col("id") % box_count).alias("box"), F.rand(seed).alias("confidence"), F.concat(F.lit("statement "), "id").alias("statement"),
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 365 as int))").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
    )
    edges = nodes.where("id >= 1").select(
        F.col("id").alias("src"), (F.col("id") - 1).alias("dst"), F.when(F.col("id") % 3 == 0, "SUPPORTS").otherwise("PART_OF").alias("etype"), F.rand(seed + 1).alias("strength")
    )
    return nodes, edges
