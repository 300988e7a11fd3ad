"""Personal data with DataFrame functions only: patterns, and terms that give them away.

Base findings are e-mail addresses, IP addresses, card and phone numbers by pattern and
check. Each value found, in the form of its kind and text, is a protected entity. Words
within `near` words of one are its context. From counts over the whole corpus,

    disclosure(entity; term) = log2( p(entity | term) / p(entity) )

tells how many bits a term reveals of an entity, where p is taken over documents. A term
that reveals at least `least_bits`, with p(entity | term) of at least `least_share`, and
that was seen with the entity in at least `least_contexts` different contexts, discloses
it: it is a `term` finding wherever it occurs as a word. Contexts are told apart by their
words, so that copies of one document do not add up to evidence. Sanitising puts the
kind's name in place of a finding (`generalise`) or cuts it out.

Only words of contexts are grouped by entity; document counts are grouped by word after
each document's words were made distinct, and summed where they are read. Documents find
their terms by doc_id and a hash of the text.

The patterns keep the stated matches, leftmost and without overlap, but are written with
possessive parts and look-behind, so that long runs of digits or letters cost no
backtracking. Places are code points, from the lengths of what lies between matches.

Defined results: a null text counts as empty and has no findings; sanitised it stays null. Null doc_ids
are told apart by their texts. Repeated rows are alike. Where findings touch the same
characters all are listed; sanitising joins them. Other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspan.llm.common import small
from linkspan.sources.scratch import settle

KINDS = ["email", "ip", "card", "phone", "term"]
_LOCAL = "[A-Za-z0-9._%+-]"
#: The stated patterns; each as text that a match must contain, and a Java pattern.
#: A match can't begin inside a run of local characters, except right after a match.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: Whole runs of digits, each after at most one space or hyphen, with 14 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Words that can be terms: letters, and digits or hyphens inside.
WORD = r"[\p{L}][\p{L}\p{N}'-]*+"

_PLACES = "array<struct<start:int,end:int,said:string>>"


def places(text: Column, pattern: Column | str, present: Column) -> Column:
    """start, end and said of all matches, in order."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    said = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern, -1)
    empty = F.array().cast(_PLACES)
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(done: Column, both: Column) -> Column:
        begin = done["at"] + F.length(both["gap"])
        end = begin + F.length(both["said"])
        one = F.struct(begin.alias("start"), end.alias("end"), both["said"].alias("said"))
        return F.struct(end.alias("at"), F.concat(done["found"], F.array(one)).alias("found"))

    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(said)).alias("gap"), said.alias("said"))
    return F.when(present, F.aggregate(pairs, start, step)["found"]).otherwise(empty)


def digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")
    ).otherwise((d.cast("int") * 2).cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def base_findings(text: Column) -> Column:
    """array of (start, rank, end, kind, said): rank is the kind's place in KINDS."""
    text = F.coalesce(text, F.lit(""))

    def many(said: Column) -> Column:
        return F.length(digits(said)).between(10, 15)

    def low(said: Column) -> Column:
        # Four significant digits are enough to tell, and never overflow.
        return F.forall(F.split(said, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").substr(1, 4).cast("int") <= 255)

    found = {
        "email": places(text, EMAIL, text.contains("@")),
        "ip": F.filter(places(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda m: low(m["said"])),
        "card": F.filter(places(text, CARD, text.rlike(r"[0-9][\x20-]?[0-9]")), lambda m: luhn(digits(m["said"]))),
        "phone": F.filter(places(text, PHONE, text.contains("+")), lambda m: many(m["said"])),
    }
    return F.concat(*(_named(found[kind], kind) for kind in KINDS[:4]))


def _named(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"),
        F.lit(kind).alias("kind"), m["said"].alias("said"),
    ))


def entity(m: Column) -> Column:
    """The value of a finding, whatever its punctuation or case."""
    value = F.when(m["kind"] == "email", F.lower(m["said"])).when(m["kind"] == "ip", m["said"]).otherwise(digits(m["said"]))
    return F.concat_ws(":", m["kind"], value)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def contexts(found: DataFrame, near: int) -> DataFrame:
    """doc_id, hash, entity, term, context for the words near each finding.

    `found` has doc_id, hash, text and base (see base_findings). The words next to a
    finding are looked for in `near * 20` characters on each side.
    """
    reach = near * 20
    each = found.select("doc_id", "hash", "text", F.explode("base").alias("m"))
    begin = F.greatest(F.col("m.start") - reach, F.lit(0))
    before = F.col("text").substr(begin + 1, F.col("m.start") - begin)
    after = F.col("text").substr(F.col("m.end") + 1, F.lit(reach))
    # A word that the cut may have halved is left out.
    left = _words(F.when(begin > 0, F.regexp_replace(before, r"^[\p{L}\p{N}'-]+", "")).otherwise(before))
    right = _words(F.when(
        F.length(after) == reach, F.regexp_replace(after, r"[\p{L}\p{N}'-]+$", "")
    ).otherwise(after))
    own = each.select("doc_id", "hash", entity(F.col("m")).alias("entity"), F.concat(
        F.slice(F.reverse(left), 1, near), F.slice(right, 1, near)
    ).alias("words"))
    return own.select(
        "doc_id", "hash", "entity", F.explode(F.array_distinct("words")).alias("term"), F.xxhash64("words").alias("context")
    )


def disclosing(
    found: DataFrame, docs: DataFrame, text: str = "text", near: int = 8, least_contexts: int = 3,
    least_share: float = 0.5, least_bits: float = 4.0,
) -> DataFrame:
    """term, entity, bits of the terms that disclose an entity. `found`: stored, see contexts."""
    seen = settle(contexts(found.where("size(base) > 0"), near), "contexts")
    joint = seen.groupBy("entity", "term").agg(
        F.countDistinct("context").alias("contexts"), F.countDistinct("doc_id", "hash").alias("docs_both")
    ).where(F.col("contexts") >= least_contexts)
    # A term is in at least the documents whose contexts it is in: most words that don't
    # disclose anything are seen with many entities, and need not be counted elsewhere.
    near_any = seen.select("term", "doc_id", "hash").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("docs_near"))
    joint = settle(joint.join(near_any, "term").where(
        F.col("docs_both") >= least_share * F.col("docs_near")
    ).drop("docs_near"), "joint")
    own = docs.select(F.explode(F.array_distinct(_words(F.col(text)))).alias("term"))
    wanted = joint.select("term").distinct()
    # Words that are no candidates are dropped before the counts are shuffled, if that can be done by broadcast.
    of_term = own.join(small(wanted, 200_000), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("docs_term"))
    of_entity = found.where("size(base) > 0").select("doc_id", "hash", F.explode(F.array_distinct(F.transform(
        "base", entity
    ))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("docs_entity"))
    total = docs.count()
    share = F.col("docs_both") / F.col("docs_term")
    bits = F.log2(share / (F.col("docs_entity") / F.lit(max(total, 1))))
    return joint.join(of_term, "term").join(of_entity, "entity").where(
        (share >= least_share) & (bits >= least_bits)
    ).select("term", "entity", bits.alias("bits"))


def findings(docs: DataFrame, text: str = "text", broadcast_rows: int = 200_000, **limits) -> DataFrame:
    """row (struct of the document's columns), text, base and all: arrays as in base_findings.

    `all` holds the base findings and the terms, by start and kind.
    """
    rows = docs.select(F.col("doc_id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    found = settle(rows.select("doc_id", "hash", "text", base_findings(F.col("text")).alias("base")).where("size(base) > 0"), "base")
    terms = settle(disclosing(found, rows, "text", **limits).select("term").distinct(), "terms")
    holding = rows.select("doc_id", "hash", F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).join(
        small(terms, broadcast_rows), "term"
    )
    lists = settle(holding.distinct().groupBy("doc_id", "hash").agg(F.sort_array(F.collect_list("term")).alias("terms")), "lists")
    # Documents that have neither findings nor terms meet nothing in the joins.
    base = found.select(F.col("doc_id").alias("id_b"), F.col("hash").alias("h_b"), "base").dropDuplicates(["id_b", "h_b"])
    held = lists.select(F.col("doc_id").alias("id_t"), F.col("hash").alias("h_t"), "terms")
    own = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(text).alias("own_hash"), F.col(text).alias("text")
    )
    joined = own.join(
        small(base, broadcast_rows), F.col("own_id").eqNullSafe(F.col("id_b")) & (F.col("own_hash") == F.col("h_b")), "left"
    ).join(
        small(held, broadcast_rows), F.col("own_id").eqNullSafe(F.col("id_t")) & (F.col("own_hash") == F.col("h_t")), "left"
    )
    kind = "array<struct<start:int,rank:int,end:int,kind:string,said:string>>"
    some = F.coalesce("terms", F.array().cast("array<string>"))
    listed = F.array_join(F.transform(some, lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}'-])(?:"), listed, F.lit(r")(?![\p{L}\p{N}'-])"))
    of_terms = _named(places(F.coalesce("text", F.lit("")), pattern, F.size(some) > 0), "term")
    base_list = F.coalesce("base", F.array().cast(kind))
    return joined.select(
        "row", "text", F.array_sort(base_list).alias("base"), F.array_sort(F.concat(base_list, of_terms)).alias("all")
    )


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")


def sanitised(text: Column, found: Column, generalise: bool = True) -> Column:
    """The text with [kind] in place of each finding, or without them."""

    def step(done: Column, m: Column) -> Column:
        fresh = m["start"] >= done["at"]
        mark = F.concat(F.lit("["), m["kind"], F.lit("]")) if generalise else F.lit("")
        between = text.substr(done["at"] + 1, F.greatest(m["start"] - done["at"], F.lit(0)))
        return F.struct(
            F.greatest(done["at"], m["end"]).alias("at"),
            F.when(fresh, F.concat(done["out"], between, mark)).otherwise(done["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(found, begin, step, lambda d: F.concat(d["out"], text.substr(d["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, text: str = "text", generalise: bool = True, **limits) -> DataFrame:
    """The documents with their text sanitised and `findings`: array of (start, end, kind)."""
    rows = findings(docs, text, **limits)
    new = F.when(F.size("all") > 0, sanitised(F.col("text"), F.col("all"), generalise)).otherwise(F.col("text"))
    found = F.transform("all", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind")))
    base = docs.drop("findings")
    return rows.select(
        *(new.alias(c) if c == text else F.col("row")[c].alias(c) for c in base.columns), found.alias("findings")
    )
