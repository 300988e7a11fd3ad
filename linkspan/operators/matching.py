"""Best registry partner of every incoming row, and its classification.

How the work is laid out:

* Incoming rows that agree on everything a comparison looks at are one *tuple*;
  it is compared once, whatever the number of copies.
* Registry rows of a block that agree on all compared values are one candidate, that of the
  smallest id number.  They are merged once, before anything is counted or joined, wherever
  many pairs are to be scored.
* A first aggregation measures the blocks.  From it follows how the join runs:
  incoming tuples of a checked size are broadcast and the registry is read in
  place (rows that meet a partner are spread over more tasks when there are many
  pairs to score); otherwise both sides are shuffled on the block; blocks too large for
  one task are cut into tiles (both sides).
* Pairs are scored batch by batch where the join produces them and only the
  best partner per tuple and batch goes on, so pairs are never shuffled.
* When a rule names a field that the score compares exactly, the much narrower
  block with that field equal is searched first; rows whose best score there
  cannot be reached without the field are done.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspan import codes
from linkspan.functions.scoring import (
    ALL_PROFILES, PROFILES, ScoreProfile, classify, missing_count, score_batch, with_rules,
)
from linkspan.operators.blocking import BLOCK, RULES, BlockingRule, with_blocks
from linkspan.operators.clean import CLEAN_COLUMNS, complete_clean_columns
from linkspan.operators.registry_index import RegistryIndex, build
from linkspan.operators.spread import join_by_file
from linkspan.sources.scratch import settle

TUPLE = "tuple_key"
ROW = ["file_id", "id"]
_NOTHING = "\u0000"


@dataclass(frozen=True)
class Limits:
    """Sizes that decide how a match runs."""

    broadcast_tuples: int = 200_000  # incoming side sent to every task up to here
    tile_incoming: int = 5_000  # tuples of one block handled by one task
    tile_master: int = 20_000
    narrow_from_pairs: int = 50_000_000  # expected pairs from which narrowing pays
    merge_from_pairs: int = 5_000_000  # pairs from which a registry read in place is merged first
    pairs_per_task: int = 1_000_000  # at most, when registry rows are spread anew
    pairs_worth_a_task: int = 25_000  # at least, while cores are free
    hot_share: int = 5_000  # a block is hot only above total/hot_share rows


@dataclass
class Layout:
    """What the measuring pass found."""

    tuples: int
    broadcast: bool
    pairs: int = 0
    narrow: bool = False
    tasks: int = 1  # registry rows that have partners are spread over so many tasks
    hot_blocks: list[tuple[str, int, int]] = field(default_factory=list)  # block, cuts in, cuts master
    hot_tuples: list[tuple[str, int]] = field(default_factory=list)  # tuple, cuts


def _fingerprint(parts: list[Column]) -> Column:
    text = F.concat_ws("\u001f", *[F.coalesce(p, F.lit(_NOTHING)) for p in parts])
    return F.md5(text)


def _incoming_rows(incoming: DataFrame, rule: BlockingRule, profile: ScoreProfile) -> DataFrame:
    """(file_id, id, missing_count, compared values, block keys, tuple key) per row."""
    values = {f"a_{f}": F.col(f"{f}_clean").cast("string") for f in profile.fields}
    keys = {f"key_{n}": key for n, key in enumerate(rule.incoming_keys())}
    rows = incoming.select(
        *ROW, F.lit(profile.grade).alias("grade"), missing_count(profile).alias("missing_count"),
        *[v.alias(n) for n, v in {**values, **keys}.items()],
    )
    # Rows without any key meet nobody; they get no tuple, so that they are not joined.
    keyed = F.coalesce(*[F.col(n) for n in keys]).isNotNull()
    return rows.withColumn(TUPLE, F.when(keyed, _fingerprint([F.col(n) for n in (*values, *keys)])))


def _incoming_tuples(rows: DataFrame, profile: ScoreProfile) -> DataFrame:
    values = [f"a_{f}" for f in profile.fields]
    keys = [F.col(n) for n in rows.columns if n.startswith("key_")]
    return (
        with_blocks(rows, keys).groupBy(TUPLE, BLOCK, *values)
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def _master_rows(master: DataFrame | RegistryIndex, rule: BlockingRule, profile: ScoreProfile) -> DataFrame:
    if isinstance(master, RegistryIndex):
        return master.rows(rule, profile)
    return with_blocks(master, rule.master_keys()).select(
        BLOCK, F.col("nik").alias("nik_master"),
        *[F.col(f"{f}_master_clean").cast("string").alias(f"b_{f}") for f in profile.fields],
    )


def _merged(master: DataFrame, profile: ScoreProfile, wanted: DataFrame | None = None) -> DataFrame:
    """One row per block and compared values, with the smallest id number, written once.

    `wanted`: few blocks, the only ones that are looked at.
    """
    if wanted is not None:
        master = master.join(F.broadcast(wanted), BLOCK, "left_semi")
    values = [f"b_{f}" for f in profile.fields]
    return settle(master.groupBy(BLOCK, *values).agg(F.min("nik_master").alias("nik_master")), "candidates")


def _measure(tuples: DataFrame, master: DataFrame, rule: BlockingRule, profile: ScoreProfile,
             limits: Limits) -> tuple[Layout, DataFrame]:
    """Measure the blocks; also the candidates to go on with, equal ones merged where it pays.

    Everything brought to the driver has a fixed bound.

    A block (or tuple) is hot above max(tile size, total / hot_share) rows, so
    there can be at most hot_share of them on either side.
    """
    mine = tuples.groupBy(BLOCK).agg(
        F.count(F.lit(1)).alias("n_in"), F.max("copies").alias("copies"),
        F.sum("copies").alias("rows_in"),
    )
    seen = mine.agg(
        F.sum("n_in").alias("n_in"), F.max("n_in").alias("max_in"),
        F.max("copies").alias("copies"), F.sum("rows_in").alias("rows_in"),
    ).first()
    n_in = int(seen["n_in"] or 0)
    layout = Layout(tuples=n_in, broadcast=n_in <= limits.broadcast_tuples)
    # Narrowing finds no row done early if another date may still score 100.
    may_narrow = rule.narrow_by is not None and profile.ceiling_without(rule.narrow_by) < 100
    if layout.broadcast:
        if rule.narrow_by:
            sizes = F.broadcast(mine.select(BLOCK, "n_in"))
            pairs = lambda: int(master.select(BLOCK).join(sizes, BLOCK).agg(F.sum("n_in")).first()[0] or 0)
            layout.pairs = pairs()
            if layout.pairs >= limits.merge_from_pairs:
                master = _merged(master, profile, mine.select(BLOCK))
                layout.pairs = pairs()
            layout.narrow = may_narrow and layout.pairs >= limits.narrow_from_pairs
            cores = master.sparkSession.sparkContext.defaultParallelism
            layout.tasks = max(
                -(-layout.pairs // limits.pairs_per_task),
                min(cores, layout.pairs // limits.pairs_worth_a_task),
            )
        return layout, master

    hot_copies = max(limits.tile_incoming, int(seen["rows_in"]) // limits.hot_share)
    if seen["copies"] > hot_copies:
        layout.hot_tuples = [
            (r[TUPLE], -(-r["copies"] // hot_copies))
            for r in tuples.groupBy(TUPLE).agg(F.max("copies").alias("copies"))
            .filter(F.col("copies") > hot_copies).collect()
        ]
    cut_in = max(limits.tile_incoming, n_in // limits.hot_share)
    if rule.unique_key:
        # One registry row per key is the rule; a sketch finds the exceptions,
        # without a shuffle of all keys.
        top = master.agg(
            F.expr(f"approx_top_k({BLOCK}, 1000, 50000)").alias("top"), F.count("*").alias("n")
        ).first()
        cut_ma = max(limits.tile_master, top["n"] // limits.hot_share)
        hot = {k: [1, -(-rows // cut_ma)] for k, rows in top["top"] if rows > cut_ma}
        if seen["max_in"] > cut_in:
            for r in mine.filter(F.col("n_in") > cut_in).collect():
                hot.setdefault(r[BLOCK], [1, 1])[0] = -(-r["n_in"] // cut_in)
        layout.hot_blocks = [(b, i, m) for b, (i, m) in hot.items()]
        if hot:
            master = _merged(master, profile)
        return layout, master

    master = _merged(master, profile)
    theirs = master.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("n_ma"))
    sizes = mine.join(theirs, BLOCK).select(BLOCK, "n_in", "n_ma")
    total = sizes.agg(
        F.sum("n_ma").alias("n_ma"), F.max("n_ma").alias("max_ma"),
        F.sum(F.col("n_in") * F.col("n_ma").cast("double")).alias("pairs"),
    ).first()
    layout.pairs = int(total["pairs"] or 0)
    layout.narrow = may_narrow and layout.pairs >= limits.narrow_from_pairs
    cut_ma = max(limits.tile_master, int(total["n_ma"] or 0) // limits.hot_share)
    if seen["max_in"] > cut_in or (total["max_ma"] or 0) > cut_ma:
        layout.hot_blocks = [
            (r[BLOCK], -(-r["n_in"] // cut_in), -(-r["n_ma"] // cut_ma))
            for r in sizes.filter((F.col("n_in") > cut_in) | (F.col("n_ma") > cut_ma)).collect()
        ]
    return layout, master


def _tiled(df: DataFrame, hot: DataFrame, own: str, other: str, spread: list[str]) -> DataFrame:
    """Add tile numbers: a row picks one cut of its own side and meets all cuts
    of the other side.  Rows of ordinary blocks stay single."""
    row_cut = F.pmod(F.xxhash64(*spread), F.coalesce(F.col(own), F.lit(1)).cast("long"))
    return (
        df.join(F.broadcast(hot), BLOCK, "left")
        .withColumn(f"tile_{own}", row_cut)
        .withColumn(
            f"tile_{other}",
            F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(other), F.lit(1)).cast("long") - 1)),
        )
        .drop(own, other)
    )


def _best_of_batches(profile: ScoreProfile):
    """Score the pairs of each batch and keep the best partner per tuple.

    Pairs of one tuple arrive next to each other, so a run of equal keys stands
    for the tuple; runs cut by a batch end are merged by the aggregation after.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            scores = score_batch(profile, batch)
            keys = batch.column(TUPLE)
            niks = batch.column("nik_master")
            change = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1))
            starts = np.concatenate(([0], np.flatnonzero(change.to_numpy(zero_copy_only=False)) + 1))
            run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
            best = np.maximum.reduceat(scores, starts)
            level = np.flatnonzero(scores == best[run])
            order = pc.sort_indices(
                pa.table({"run": run[level], "nik": niks.take(pa.array(level))}),
                sort_keys=[("run", "ascending"), ("nik", "ascending")],
            ).to_numpy()
            level = level[order]
            first = np.concatenate(([True], np.diff(run[level]) > 0))
            rows = pa.array(level[first])
            yield pa.RecordBatch.from_arrays(
                [keys.take(rows), pa.array(scores[level[first]]), niks.take(rows)],
                names=[TUPLE, "score", "nik_master"],
            )

    return reduce


def _best_partner(pairs: DataFrame, profile: ScoreProfile) -> DataFrame:
    """(tuple key, score, nik_master): highest score, smallest nik among ties."""
    values = [f"{side}_{f}" for f in profile.fields for side in "ab"]
    reduced = pairs.select(TUPLE, "nik_master", *values).mapInArrow(
        _best_of_batches(profile), f"{TUPLE} string, score double, nik_master string"
    )
    ranked = F.struct((-F.col("score")).alias("lost"), F.col("nik_master").alias("nik"))
    return (
        reduced.groupBy(TUPLE).agg(F.min(ranked).alias("top"))
        .select(TUPLE, (-F.col("top.lost")).alias("score"), F.col("top.nik").alias("nik_master"))
    )


def _search(tuples: DataFrame, master: DataFrame, profile: ScoreProfile, layout: Layout,
            narrow_by: str | None = None) -> DataFrame:
    """Best partner per tuple over the blocks, or over the part of each block
    that agrees on `narrow_by`."""
    on = [BLOCK]
    if narrow_by:
        on.append("agreed")
        tuples = tuples.withColumn("agreed", F.col(f"a_{narrow_by}"))
        master = master.withColumn("agreed", F.col(f"b_{narrow_by}"))
    if layout.broadcast:
        if layout.tasks > 1:
            met = F.broadcast(tuples.select(*on).distinct())
            master = master.join(met, on, "left_semi").repartition(layout.tasks, BLOCK, "nik_master")
        return _best_partner(master.join(F.broadcast(tuples), on), profile)
    if layout.hot_blocks:
        values = [f"b_{f}" for f in profile.fields]
        hot = tuples.sparkSession.createDataFrame(
            layout.hot_blocks, f"{BLOCK} string, cut_in int, cut_ma int"
        )
        tuples = _tiled(tuples, hot, "cut_in", "cut_ma", [TUPLE])
        master = _tiled(master, hot, "cut_ma", "cut_in", values)
        on += ["tile_cut_in", "tile_cut_ma"]
    return _best_partner(tuples.join(master, on), profile)


def _give_back(rows: DataFrame, best: DataFrame, layout: Layout) -> DataFrame:
    """Best partner of each tuple to all its rows; rows without one stay."""
    if layout.broadcast:  # at most as many rows as the tuples measured
        return rows.join(F.broadcast(best), TUPLE, "left")
    keyless = rows.filter(F.col(TUPLE).isNull()).withColumns({
        "score": F.lit(None).cast("double"), "nik_master": F.lit(None).cast("string"),
    })
    rows = rows.filter(F.col(TUPLE).isNotNull())
    if not layout.hot_tuples:
        return rows.join(best, TUPLE, "left").unionByName(keyless)
    hot = F.broadcast(
        rows.sparkSession.createDataFrame(layout.hot_tuples, f"{TUPLE} string, cuts int")
    )
    cuts = F.coalesce(F.col("cuts"), F.lit(1)).cast("long")
    rows = rows.join(hot, TUPLE, "left").withColumn("part", F.pmod(F.xxhash64(*ROW), cuts))
    best = best.join(hot, TUPLE, "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), cuts - 1))
    )
    found = rows.drop("cuts").join(best.drop("cuts"), [TUPLE, "part"], "left").drop("part")
    return found.unionByName(keyless)


def best_matches(incoming: DataFrame, master: DataFrame | RegistryIndex, rule: BlockingRule,
                 profile: ScoreProfile, limits: Limits = Limits()) -> DataFrame:
    """(file_id, id, grade, missing_count, score, nik_master) for every incoming row.

    Rows without any candidate have a null score. With an index of the registry its
    rows are neither cleaned nor keyed again, nor shuffled where the incoming side is.
    """
    # Read several times below and dear to compute, so written once.
    rows = settle(_incoming_rows(complete_clean_columns(incoming), rule, profile), "incoming")
    tuples = settle(_incoming_tuples(rows, profile), "tuples")
    layout, candidates = _measure(tuples, _master_rows(master, rule, profile), rule, profile, limits)
    if layout.narrow:
        close = settle(_search(tuples, candidates, profile, layout, rule.narrow_by), "narrow")
        done = close.filter(F.col("score") > profile.ceiling_without(rule.narrow_by) + 1e-6)
        rest = tuples.join(done.select(TUPLE), TUPLE, "left_anti")
        best = done.unionByName(_search(rest, candidates, profile, layout))
    else:
        best = _search(tuples, candidates, profile, layout)
    return _give_back(rows.select(*ROW, "grade", "missing_count", TUPLE), best, layout).drop(TUPLE)


def _as_results(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Final score and result per row; a row without candidate is unmatched."""
    graded = with_rules(found, rules)
    no_partner = F.col("nik_master").isNull()
    return graded.select(
        "file_id",
        F.col("id").alias("id_incoming"),
        "nik_master",
        F.when(no_partner, 0.0).otherwise(F.round("score", 2)).alias("match_score"),
        "missing_count",
        F.when(no_partner, codes.AUTO_UNMATCH)
        .otherwise(classify(F.col("score"), F.col("missing_count"))).alias("match_result"),
    )


def link(incoming: DataFrame, master: DataFrame | RegistryIndex, grade: int, rules: DataFrame, *,
         rule: BlockingRule | None = None, profile: ScoreProfile | None = None,
         limits: Limits = Limits()) -> DataFrame:
    """Match cleaned incoming rows of one grade with the cleaned registry.

    One result row per incoming row: file_id, id_incoming, nik_master,
    match_score, missing_count, match_result.
    """
    if grade not in RULES:
        raise ValueError(f"Unsupported grade: {grade}")
    profile = profile or PROFILES[grade]
    found = best_matches(incoming, master, rule or RULES[grade], profile, limits)
    return _as_results(found, rules)


def candidates_of(sql: str, incoming: DataFrame, master: DataFrame) -> DataFrame:
    """The relation that a user's SQL makes of incoming_df and master_df.

    The two names exist in the text only: other queries of the session don't see them.
    """
    own = sql.strip().rstrip(";").replace("{", "{{").replace("}", "}}")
    text = (
        "WITH incoming_df AS (SELECT * FROM {incoming}), master_df AS (SELECT * FROM {master}) SELECT * FROM (" + own + "\n)"
    )
    return incoming.sparkSession.sql(text, incoming=incoming, master=master)


def best_of_pairs(pairs: DataFrame, profile: ScoreProfile, pieces: int = 64) -> DataFrame:
    """Best partner per tuple over candidates that come in any order and number.

    A tuple may hold a large part of all pairs. They are scored where they are, then the
    best of each task goes to one of `pieces` pieces of its tuple by its partner's number, and
    the best of the pieces is taken: no task sees all pairs, or all tasks' results, of a tuple.
    """
    values = [f"{side}_{f}" for f in profile.fields for side in "ab"]
    reduced = pairs.select(TUPLE, "nik_master", *values).mapInArrow(
        _best_of_batches(profile), f"{TUPLE} string, score double, nik_master string"
    )
    ranked = F.struct((-F.col("score")).alias("lost"), F.col("nik_master").alias("nik"))
    piece = F.pmod(F.xxhash64("nik_master"), F.lit(pieces)).cast("int")
    parts = reduced.groupBy(TUPLE, piece.alias("piece")).agg(F.min(ranked).alias("top"))
    return parts.groupBy(TUPLE).agg(F.min("top").alias("top")).select(
        TUPLE, (-F.col("top.lost")).alias("score"), F.col("top.nik").alias("nik_master")
    )


def _named_in(sql: str, columns: list[str]) -> list[str]:
    """The columns that a text may read: those whose names occur in it, all of them if it has a star."""
    return columns if "*" in sql else [c for c in columns if c.lower() in sql.lower()]


def link_with_sql(incoming: DataFrame, master: DataFrame, sql: str, grade: int,
                  rules: DataFrame, *, profile: ScoreProfile | None = None, by_values: bool = False) -> DataFrame:
    """Match with candidates given by a user's SQL text.

    The text reads incoming_df and master_df and returns incoming_row_id, nik_master and
    any of the cleaned columns.  Columns it leaves out count as missing.  When several
    files are matched at once it must also return file_id; rows of a null file are their own.

    `by_values` says that the text pairs rows by cleaned columns alone: whether two rows meet
    doesn't rest on numbers, files, raw values or how many rows there are.  Then rows that agree
    on all cleaned columns named in the text stand for each other: the text gets one row of each
    (of the registry that with the smallest nik; of the incoming side with an id of its own, a null
    file_id and no raw columns), and what it finds goes to all rows.
    """
    profile = profile or PROFILES[grade]
    incoming = settle(  # read twice below
        complete_clean_columns(incoming).withColumn("grade", F.lit(grade)), "incoming"
    )
    asked = incoming
    if by_values:
        mine = _named_in(sql, [c for c in CLEAN_COLUMNS])
        theirs = _named_in(sql, [c for c in master.columns if c.endswith("_master_clean")])
        alike = _fingerprint([F.col(c).cast("string") for c in mine])
        asked = settle(incoming.select(*mine).distinct().withColumns(
            {"id": alike, "file_id": F.lit(None).cast("string")}), "values")
        master = settle(master.groupBy(*theirs).agg(F.min("nik").alias("nik")), "values")
    pairs = candidates_of(sql, asked, master)
    named = {name.lower() for name in pairs.columns}
    text = lambda name: (F.col(name) if name in named else F.lit(None)).cast("string")
    by_file = "file_id" in named
    key = lambda file, row: F.to_json(F.struct(file.alias("f"), row.cast("string").alias("r")))
    values = [text(f"{f}_clean").alias(f"a_{f}") for f in profile.fields]
    values += [text(f"{f}_master_clean").alias(f"b_{f}") for f in profile.fields]
    pairs = pairs.filter(F.col("nik_master").isNotNull()).select(
        key(text("file_id"), F.col("incoming_row_id")).alias(TUPLE), F.col("nik_master").cast("string"), *values
    )
    best = best_of_pairs(pairs, profile)
    own_file = F.col("file_id").cast("string") if by_file else F.lit(None).cast("string")
    own = key(F.lit(None).cast("string"), alike) if by_values else key(own_file, F.col("id"))
    rows = incoming.select(
        *ROW, "grade", missing_count(profile).alias("missing_count"), own.alias(TUPLE),
    )
    return _as_results(rows.join(best, TUPLE, "left"), rules)


#: A table of rules: a text of candidates and a profile's name besides the thresholds; both may be null.
#: A further boolean column by_values may say of a text what `link_with_sql` describes.
RULE_TABLE_SCHEMA = (
    "grade_code int, matching_query string, profile string, auto_missing_max int, auto_score_min double, "
    "review_missing_count int, review_score_min double, review_score_max double"
)


def _grades_of(files: DataFrame) -> list[int]:
    known = F.when(F.col("grade").isin(*RULES), F.col("grade")).otherwise(0)
    grades = sorted(r[0] for r in files.select(known).distinct().collect())  # at most six
    if 0 in grades:
        raise ValueError("Unsupported grade among the files")
    return grades or [codes.GRADE_A]


def _of_all_grades(files: DataFrame, incoming: DataFrame, grades: list[int], one) -> DataFrame:
    """Each grade's results are written before the next grade begins: the tuples and partners that
    are sent to the tasks pass the driver, which so never holds those of all grades at a time."""
    out = None
    for grade in grades:
        mine = files.filter(F.col("grade") == grade).select("file_id")
        part = settle(one(grade, join_by_file(incoming, mine, "id", "left_semi")), "matched")
        out = part if out is None else out.unionByName(part)
    dates = files.select("file_id", F.col("upload_timestamp").alias("upload_date"))
    return join_by_file(out, dates, "id_incoming")


def link_files(files: DataFrame, incoming: DataFrame, master: DataFrame | RegistryIndex, rules: DataFrame,
               limits: Limits = Limits()) -> DataFrame:
    """Match the rows of many files, each by the rule of its file's grade.

    Only the grades that occur are run; a file whose grade is outside 1-5 is
    refused. A registry that is no index yet is read once, to make one for all grades.
    Rules with texts of candidates or profile names are those of `link_files_by_table`.
    """
    if "matching_query" in rules.columns:
        index = master if isinstance(master, RegistryIndex) else None
        return link_files_by_table(files, incoming, None if index else master, rules, limits, index)
    grades = _grades_of(files)
    index = master if isinstance(master, RegistryIndex) else _index_for(master, {g: PROFILES[g] for g in grades})
    return _of_all_grades(files, incoming, grades, lambda grade, rows: link(rows, index, grade, rules, limits=limits))


def _index_for(master: DataFrame, profiles: dict[int, ScoreProfile]) -> RegistryIndex:
    """An index for one run: the rules of these grades and the fields that their profiles compare."""
    buckets = int(master.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = sorted({f for p in profiles.values() for f in p.fields})
    return build(master, buckets=buckets, rules=sorted({RULES[g].name for g in profiles}), fields=fields)


def link_files_by_table(files: DataFrame, incoming: DataFrame, master: DataFrame | None, table: DataFrame,
                        limits: Limits = Limits(), index: RegistryIndex | None = None) -> DataFrame:
    """Match the rows of many files by a table of rules, one row per grade.

    A grade's row may hold a text of its candidates (`matching_query`, see `link_with_sql`) or
    none, for the grade's own blocking rule; the name of a score profile or none, for the
    grade's own; and its thresholds. A grade that occurs without a row is refused, and so
    is one with two, or a name that no profile has. `index`: of the registry, if there is one.
    """
    grades = _grades_of(files)
    rows = table.filter(F.col("grade_code").isin(grades)).limit(len(grades) + 1).collect()
    found = {r["grade_code"]: r for r in rows}
    if len(found) < len(rows) or len(rows) > len(grades):
        raise ValueError("a grade has two rules")
    if missing := [g for g in grades if g not in found]:
        raise ValueError(f"No matching rule for grade {missing[0]}")
    if unknown := [r["profile"] for r in rows if r["profile"] and r["profile"] not in ALL_PROFILES]:
        raise ValueError(f"No score profile {unknown[0]}")
    if master is None and any(r["matching_query"] for r in rows):
        raise ValueError("a text of candidates needs the registry itself, not an index of it")
    thresholds = table.drop("by_values")
    profiles = {
        g: replace(ALL_PROFILES[r["profile"]], grade=g) if r["profile"] else PROFILES[g] for g, r in found.items()
    }
    by_block = {g: p for g, p in profiles.items() if not found[g]["matching_query"]}
    if index is None and by_block:
        index = _index_for(master, by_block)

    def one(grade: int, mine: DataFrame) -> DataFrame:
        text, profile = found[grade]["matching_query"], profiles[grade]
        if text:
            alike = "by_values" in table.columns and bool(found[grade]["by_values"])
            return link_with_sql(mine, master, text, grade, thresholds, profile=profile, by_values=alike)
        return link(mine, index, grade, thresholds, profile=profile, limits=limits)

    return _of_all_grades(files, incoming, grades, one)


def match_summary(results: DataFrame) -> DataFrame:
    """Processed, matched, review and unmatched rows per file."""
    of = lambda code: F.count_if(F.col("match_result") == code)
    return results.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("processed_rows"),
        of(codes.AUTO_MATCH).alias("matched_rows"),
        of(codes.REVIEW).alias("manual_review_rows"),
        of(codes.AUTO_UNMATCH).alias("unmatched_rows"),
    )


def file_sync_status(results: DataFrame) -> DataFrame:
    """1 while a file has rows to review, else 3."""
    open_rows = F.max((F.col("match_result") == codes.REVIEW).cast("int")) == 1
    return results.groupBy("file_id").agg(
        F.when(open_rows, codes.SYNC_IN_PROGRESS).otherwise(codes.SYNC_COMPLETED).alias("sync_status")
    )
