"""Secret scans over a trigram inverted index: posting lists are intersected and only candidates are searched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, whole_text
from .secret_rules import ALWAYS, RULES, Rule, trigram_query

REDACTED = "[SECRET]"


def _key() -> Column:
    """Names a row in the index; two rows that share a key only become candidates together."""
    return F.xxhash64(F.col("doc_id"), whole_text())


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings ``(trigram, key)`` of the lower-cased texts, for the trigrams that the rules ask for."""
    wanted = sorted({t for rule in rules for part in trigram_query(rule.pattern) for t in part})
    rows = docs.select(_key().alias("key"), F.lower(whole_text()).alias("low"))
    present = [F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]
    found = F.array_compact(F.array(*present)) if present else F.array().cast("array<string>")
    return rows.select("key", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(key, kinds)``: the rules that a row may match, from the intersection of its posting lists.

    A row has at most as many postings as the rules have trigrams.  Rules without a trigram are not in the index.
    """
    held = index.groupBy("key").agg(F.collect_set("trigram").alias("held"))

    def holds(query) -> Column:
        every = [reduce(Column.__and__, [F.array_contains("held", t) for t in sorted(part)]) for part in query]
        return reduce(Column.__or__, every)

    indexed = [(r, q) for r in rules if (q := trigram_query(r.pattern)) != ALWAYS]
    kinds = F.array_compact(F.array(*[F.when(holds(q), F.lit(r.kind)) for r, q in indexed]))
    return held.select("key", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """Spans of one rule as ``(start, place, end)``: matches and the gaps between them, added up along the text."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    walk = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), checked.alias("checked"))
    none = F.array().cast("array<struct<start:int,place:int,end:int>>")

    def step(done: Column, one: Column) -> Column:
        start = done["at"] + F.char_length(one["gap"])
        end = start + F.char_length(one["hit"])
        new = F.array(F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end")))
        long_enough = F.char_length(one["checked"]) >= rule.least
        out = F.when(long_enough, F.concat(done["spans"], new)).otherwise(done["spans"])
        return F.struct(end.alias("at"), out.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.aggregate(walk, start, step, lambda done: done["spans"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``secrets``: an array of ``(start, place, end)`` sorted by start, then by the rule's place in ``rules``.

    Offsets are code points of the whole text, end exclusive.  Of each rule the leftmost matches that do not overlap are found first, then
    those that are too short are dropped.  Rules with trigrams search the index's candidates only, the others every
    text.  A null or empty text has no spans.  All columns are kept; one already called ``secrets`` is replaced.
    """
    docs = docs.drop("secrets")
    index = materialize(build_index(docs, rules), "trigrams")
    maybe = candidates(index, rules).withColumnsRenamed({"key": "__key", "kinds": "__kinds"})
    keyed = docs.withColumn("__own_key", _key())
    rows = keyed.join(maybe, F.col("__own_key") == F.col("__key"), "left")
    text, none = whole_text(), F.array().cast("array<struct<start:int,place:int,end:int>>")
    found = []
    for place, rule in enumerate(rules):
        if trigram_query(rule.pattern) != ALWAYS:
            may = F.array_contains("__kinds", rule.kind)
        else:
            may = text.rlike(f"{rule.pattern[:-1]}{{{rule.least}}}" if _is_class(rule) else rule.pattern)
        found.append(F.when(may, _spans(text, rule, place)).otherwise(none))
    return rows.withColumn("secrets", F.array_sort(F.concat(*found))).drop("__own_key", "__key", "__kinds")


def _is_class(rule: Rule) -> bool:
    """A repeated character class: a long enough match is a run of that many characters."""
    return rule.group == 0 and rule.pattern.startswith("[") and rule.pattern.endswith("]+") and rule.pattern.count("[") == 1


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, separated by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    one = lambda s: F.concat_ws(":", F.element_at(kinds, s["place"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of every row, by the base and further rules."""
    scanned = scan(docs.select("doc_id", "text"))
    base = [k for k, r in enumerate(RULES) if r.base]
    number = lambda k: F.size(F.filter("secrets", lambda s: s["place"] == k)).cast("bigint")
    kept = F.filter("secrets", lambda s: s["place"] <= max(base))
    return scanned.select(
        "doc_id",
        *[number(k).alias(f"n_{RULES[k].kind}") for k in base],
        F.sha2(joined(kept).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def redact(scanned: DataFrame, mark: str = REDACTED) -> DataFrame:
    """Replace the spans in ``secrets`` by a mark and drop that column; spans that touch or overlap share one mark.

    ``n_chars``, where it exists, follows a changed text; texts without spans are left as they are.
    """

    def step(done: Column, span: Column) -> Column:
        fresh = span["start"] > done["at"]
        gap = F.substring(F.col("text"), done["at"] + 1, span["start"] - done["at"])
        out = F.when(fresh | (done["at"] == 0), F.concat(done["out"], gap, F.lit(mark))).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), out.alias("out"))

    rest = lambda done: F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.char_length("text")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    changed = F.size("secrets") > 0
    text = F.when(changed, F.aggregate("secrets", start, step, rest)).otherwise(F.col("text"))
    out = scanned.withColumn("__text", text)
    if "n_chars" in scanned.columns:
        length = F.char_length("__text").cast(scanned.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("__text")).drop("__text", "secrets")
