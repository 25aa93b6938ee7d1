"""Scalar kernels as Column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds, factors and vocabularies that results depend on.
BANDS = (("true", 0.75), ("plausible", 0.5), ("implausible", 0.25))
QUALITY_FACTOR = {"digital": 1.0, "ocr": 0.85, "handwritten": 0.6}
QUALITY_RANK = {"digital": 0, "ocr": 1, "handwritten": 2}
VERDICT_FACTOR = {"contradicted": 0.0, "neutral": 0.3, "entailed": 1.0}
POLARITY_LOST, MODALITY_LOST = 0.4, 0.7
LOW_FAITHFULNESS = 0.5
ROUTES = {"observation": "fact", "testimony": "judgement", "judgement": "judgement"}
INTEREST_GATE = {"observation": 0.0, "testimony": 1.0, "judgement": 1.0}
INTEREST_RAW = {"self": 0.5, "neutral": 1.0, "against": 1.3, "unknown": 1.0}
CONFIRMED, CANDIDATE, TIE_MARGIN = 0.85, 0.5, 0.05
NAMESPACE_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """``table[key]``, null (or ``default``) where the key is absent."""
    out = F.lit(None) if default is None else default
    for name, value in table.items():
        out = F.when(key == F.lit(name), F.lit(value)).otherwise(out)
    return out


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def normalize_label(x: Column) -> Column:
    """Lower case, runs of other than a-z0-9 to one space, trimmed, one leading article dropped."""
    plain = F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    return F.trim(F.regexp_replace(plain, "^(the|a|an)( |$)", ""))


def tokens(normal: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal, " "), lambda t: t != ""))


def lexemes(x: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def information_density(x: Column) -> Column:
    """Numbers + capitalised words of two letters and more + percent and dollar signs."""
    return F.regexp_count(x, F.lit(r"\d+")) + F.regexp_count(x, F.lit(r"(?<![\p{L}\p{N}_])[A-Z][a-z]+(?![\p{L}\p{N}_])")) + F.regexp_count(x, F.lit(r"[$%]"))


def sentences(x: Column) -> Column:
    """Runs up to sentence marks that white space or the end follows; what has no such end is dropped."""
    found = F.regexp_extract_all(x, F.lit(r"[^.!?\n]+(?:[.!?]+(?=\s|$)|$)"), 0)
    return F.filter(found, lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def uuid5(name: Column, namespace: str | Column = NAMESPACE_URL) -> Column:
    space = F.lit(namespace) if isinstance(namespace, str) else namespace
    h = F.sha1(F.concat(F.unhex(F.replace(space, F.lit("-"), F.lit(""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant,
        F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def ascii_json(x: Column) -> Column:
    """A JSON string literal with everything outside ASCII escaped as UTF-16 units, null as ``null``.

    Characters are taken from the UTF-16 bytes of the text, four hex digits a unit.
    """
    units = F.regexp_extract_all(F.lower(F.hex(F.encode(x, "UTF-16BE"))), F.lit("[0-9a-f]{4}"), 0)
    short = {"0022": '\\"', "005c": "\\\\", "000a": "\\n", "000d": "\\r", "0009": "\\t", "0008": "\\b", "000c": "\\f"}

    def unit(u: Column) -> Column:
        plain = F.decode(F.unhex(F.substring(u, 3, 2)), "US-ASCII")
        out = F.when((u >= "0020") & (u <= "007e"), plain).otherwise(F.concat(F.lit("\\u"), u))
        for code, text in short.items():
            out = F.when(u == code, F.lit(text)).otherwise(out)
        return out

    return F.coalesce(F.concat(F.lit('"'), F.array_join(F.transform(units, unit), ""), F.lit('"')), F.lit("null"))


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of a compact JSON object with sorted keys; the fields are JSON text already."""
    parts = [F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def band(x: Column) -> Column:
    out = F.lit("false")
    for name, least in reversed(BANDS):
        out = F.when(x >= least, F.lit(name)).otherwise(out)
    message = F.concat(F.lit("acceptability outside 0..1: "), x.cast("string"))
    return F.when((x < 0) | (x > 1), F.raise_error(message).cast("string")).otherwise(out)


def state(acceptability: Column, support: Column, attack: Column) -> Column:
    high = band(acceptability).isin("true", "plausible")
    return F.when(high, F.lit("supported")).when(attack > support, F.lit("refuted")).otherwise(F.lit("unsupported"))


def df_quad(base: Column, support: Column, attack: Column) -> Column:
    up = base + (1 - base) * (support - attack)
    down = base - base * (attack - support)
    return F.when(support > attack, up).when(attack > support, down).otherwise(base)


def quadratic_energy(base: Column, support: Column, attack: Column) -> Column:
    energy = support - attack
    pull = lambda e: e * e / (1 + e * e)
    up = base + (1 - base) * pull(energy)
    down = base - base * pull(energy)
    return F.when(energy > 0, up).when(energy < 0, down).otherwise(base)


def prob_sum(x: Column) -> Column:
    """Aggregate 1 - product(1 - x); 0 for no rows."""
    return F.coalesce(1 - F.product(1 - x), F.lit(0.0))


def exact_sum(x: Column) -> Column:
    """Aggregate: the sum of doubles rounded once, whatever order rows come in; 0 for no rows.

    Each is cut at 30, 61 and 92 binary places into three whole numbers, whose sums know no rounding. What is
    not a number or too large for this leaves the plain sum.
    """
    fits = F.abs(x) < 2.0**30
    parts, rest = [], F.when(fits, x)
    for bits in (30, 31, 31):
        rest = rest * 2.0**bits
        parts.append(F.floor(rest))
        rest = rest - F.floor(rest).cast("double")
    high, middle, low = (F.sum(p).cast("double") for p in parts)
    exact = high * 2.0**-30 + (middle * 2.0**-61 + low * 2.0**-92)
    return F.coalesce(F.when(F.count_if(~fits) == 0, exact).otherwise(F.sum(x)), F.lit(0.0))


def faithfulness(verdict: Column, polarity_kept: Column, modality_kept: Column) -> Column:
    kept = F.when(polarity_kept, 1.0).otherwise(POLARITY_LOST) * F.when(modality_kept, 1.0).otherwise(MODALITY_LOST)
    return lookup(verdict, VERDICT_FACTOR) * kept


def parse_quality(quality: Column) -> Column:
    return lookup(quality, QUALITY_FACTOR, F.lit(1.0))


def combine_faithfulness(verify: Column, agreement: Column, quality: Column, curve=lambda a: a) -> Column:
    return verify * curve(agreement) * quality


def provisional_reasons(score: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(score.isNull(), F.array(F.lit("unassessed_faithfulness"))).when(score < LOW_FAITHFULNESS, F.array(F.lit("low_faithfulness"))).otherwise(none)


def decode_reasons(stored: Column) -> Column:
    """Reasons stored as a JSON list; none for a null."""
    return F.coalesce(F.from_json(stored, "array<string>"), F.array().cast("array<string>"))


def legacy_provisional(score: Column, reasons: Column) -> Column:
    """The old flag: null where nothing was determined, else whether there is any reason."""
    return F.when(score.isNotNull() | (F.size(reasons) > 0), F.size(reasons) > 0)


def flatten_sensitivity(level: Column, compartments: Column) -> Column:
    """Flat properties of a sensitivity; none stored is public without compartments."""
    held = F.sort_array(F.array_distinct(F.coalesce(compartments, F.array().cast("array<string>"))))
    return F.struct(F.coalesce(level, F.lit("public")).alias("sensitivity_level"), F.to_json(held).alias("sensitivity_compartments"))


def read_sensitivity(level: Column, compartments: Column) -> Column:
    """Level and compartments from flat properties, the latter a JSON list, empty or null."""
    held = F.from_json(F.when(compartments != "", compartments), "array<string>")
    return F.struct(F.coalesce(level, F.lit("public")).alias("level"), F.coalesce(held, F.array().cast("array<string>")).alias("compartments"))


def flatten_interest(known: Column, role: Column, stake: Column) -> Column:
    """Flat properties of a source's interest; null where it is unknown, which is not the same as no stake."""
    held = F.sort_array(F.array_distinct(F.coalesce(stake, F.array().cast("array<string>"))))
    return F.when(known, F.struct(role.alias("interest_role"), held.alias("interest_stake")))


def reassess_reasons(reasons: Column, score: Column) -> Column:
    """Replace only the reasons that concern faithfulness."""
    axis = F.array(F.lit("unassessed_faithfulness"), F.lit("low_faithfulness"))
    return F.sort_array(F.array_union(F.array_except(reasons, axis), provisional_reasons(score)))


def route_for(epistemic_class: Column) -> Column:
    return lookup(epistemic_class, ROUTES)


def seed_confidence(score: Column) -> Column:
    return F.coalesce(score, F.lit(1.0))


def interest_modifier(epistemic_class: Column, alignment: Column) -> Column:
    gate = lookup(epistemic_class, INTEREST_GATE, F.lit(1.0))
    return 1 + gate * (lookup(alignment, INTEREST_RAW, F.lit(1.0)) - 1)


def effective_credibility(prior: Column, epistemic_class: Column, alignment: Column) -> Column:
    return clamp(prior * interest_modifier(epistemic_class, alignment))


def edge_significance(tier_weight: Column, credibility: Column) -> Column:
    return clamp(tier_weight * F.coalesce(credibility, F.lit(1.0)))


def resolution_score(exact: Column, type_match: Column, shared_context: Column, shared_roles: Column) -> Column:
    """``type_match`` is 1, -1 or 0 where a type is missing."""
    relational = 1 - F.pow(F.lit(0.5), shared_context + 0.5 * shared_roles)
    return clamp(0.5 * exact.cast("double") + 0.25 * type_match + 0.35 * relational)


def resolution_state(score: Column) -> Column:
    return F.when(score >= CONFIRMED, "confirmed").when(score >= CANDIDATE, "candidate")


def containment(inner: Column, outer: Column) -> Column:
    """Share of ``inner``'s tokens that ``outer`` has; 0 for no tokens."""
    return F.when(F.size(inner) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(inner, outer)) / F.size(inner))


def binding_score(mention: Column, referent: Column, exact: Column, kind_match: Column) -> Column:
    return clamp(0.6 * containment(mention, referent) + 0.25 * exact.cast("double") + 0.15 * kind_match.cast("double"))


def taxonomy_score(mention: Column, node: Column, exact: Column) -> Column:
    return clamp(0.7 * containment(mention, node) + 0.3 * exact.cast("double"))


def anchor_score(entity: Column, node: Column, exact: Column, type_match: Column) -> Column:
    most = F.greatest(containment(entity, node), containment(node, entity))
    return clamp(0.55 * most + 0.4 * exact.cast("double") + 0.05 * type_match.cast("double"))


def opinion(positive: Column, negative: Column, base_rate: Column | float = 0.5, prior_weight: float = 2.0) -> Column:
    """Subjective opinion of evidence counts."""
    total = positive + negative + prior_weight
    rate = base_rate if isinstance(base_rate, Column) else F.lit(float(base_rate))
    return F.struct(
        (positive / total).alias("belief"), (negative / total).alias("disbelief"), (F.lit(prior_weight) / total).alias("uncertainty"), rate.alias("base_rate")
    )


def projected(o: Column) -> Column:
    return o["belief"] + o["base_rate"] * o["uncertainty"]


def discount(o: Column, trust: Column) -> Column:
    b, d = o["belief"] * trust, o["disbelief"] * trust
    return F.struct(b.alias("belief"), d.alias("disbelief"), (1 - b - d).alias("uncertainty"), o["base_rate"].alias("base_rate"))


def skip_reason(text: Column, vector: Column) -> Column:
    blank = F.trim(F.regexp_replace(text, r"\s+", " ")) == ""
    return F.when(blank, "whitespace").when(norm(vector) == 0, "zero_vector")


def is_transitive(meronymy: Column) -> Column:
    return meronymy == "component-integral"


def worst_quality(qualities: Column) -> Column:
    """The worst known quality of an array; null if none is known."""
    rank = F.array_max(F.transform(qualities, lambda q: lookup(q, QUALITY_RANK)))
    return lookup(rank, {v: k for k, v in QUALITY_RANK.items()})


def current(valid_to: Column) -> Column:
    return valid_to.isNull()


def as_of(valid_from: Column, valid_to: Column, at: Column) -> Column:
    return (valid_from <= at) & (valid_to.isNull() | (valid_to > at))
