"""Mixing sources to target weights by Pareto order sampling.

A source that gets ``r`` times its words gives every document ``floor(r)``
certain whole copies.  The fraction left is drawn without replacement: document
``i`` has inclusion probability ``p_i`` proportional to its size, with
``sum(p_i * size_i)`` equal to the words still wanted; documents are ranked by
random odds divided by inclusion odds, and the lowest ranks are taken while
they fit the wanted words; one more document fills the gap best.  The uniform
numbers come from a digest of seed and id, so reruns agree.

A single draw ends at the first rank that does not fit, so one very long
document can leave most of a source's words untaken.  With ``fill``, as in the
registered query and its SQL, the draw goes on in rounds: every round draws, with
probabilities of its own, from the documents left that are no longer than the
words still wanted, until none fits; then one more fills the gap best.

Ranks are never sorted per source: sizes are summed over cells of the rank
axis, and only the cell that holds the cut is ordered.

Defined results: null texts have size 0 and take 0; null sources are a source
of their own, last in order; rows equal in id, size and source tie and are
taken together; a mix without any words takes nothing; an empty table gives an
empty result; other columns pass through by position, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.common import apart, by_key, pick, word_count, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SEED = "mix-1"
CELLS = 4096
# A table of at most this many sources (a name and a few numbers each) is sent to every task.
BROADCAST_SOURCES = 20_000


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    d = pick(docs, doc_id=id_col, source=source_col, text=text_col)
    return d.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def allocate(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source: words, weight and target; targets stop at ``max_repeats`` times the source.

    The final targets are ``min(limit, level * weight)`` with one common level.
    The sources that reach their limit are those with the smallest limit per
    weight, so the level follows from running sums in that order.  Windows here
    run over one row per source, not over documents.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"),
                                    F.sum(F.col("size").cast("decimal(19,0)") * F.col("size")).alias("squares"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", turn).withColumn("limit", F.col("source_size") * max_repeats)
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = (s.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(upto), F.lit(0)))
          .withColumn("share", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
          .withColumn("level", F.col("left") / F.col("share"))
          .withColumn("full", F.col("limit") < F.col("level") * F.col("weight")))
    # the first source that does not reach its limit fixes the level of all after it
    level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(
        Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("limit").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return s.select("source", "source_size", "squares", "weight", target.alias("target"))


def _uniform(doc_id: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 from 48 bits of a digest of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _planned(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the plan of the source, ``certain`` copies and the words ``wanted`` beyond them."""
    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    s = plan.withColumnRenamed("source", "plan_source")
    d = sized.join(F.broadcast(s) if few else s, sized["source"].eqNullSafe(s["plan_source"])).drop("plan_source")
    size = F.col("source_size").cast("double")
    ratio = F.when(size > 0, F.col("target") / size).otherwise(F.lit(0.0))
    d = d.withColumn("certain", F.floor(ratio).cast("bigint"))
    return d.withColumn("wanted", F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0)))


def _rank(wanted: Column, squares: Column, u: Column) -> Column:
    """The rank ``z`` in [0, 1]: Pareto's ratio q as q / (1 + q)."""
    squares = squares.cast("double")
    p = F.when(squares > 0, wanted * F.col("size") / squares).otherwise(F.lit(0.0))
    # q / (1 + q) with q = (u / (1 - u)) / (p / (1 - p)), without a division by zero
    return F.when(p >= 1, F.lit(0.0)).when(p <= 0, F.lit(1.0)).otherwise(u * (1 - p) / (u * (1 - p) + (1 - u) * p))


def _ranked(sized: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """Adds ``certain`` copies and the rank ``z``."""
    return _planned(sized, plan).withColumn("z", _rank(F.col("wanted"), F.col("squares"), _uniform(F.col("doc_id"), seed)))


def _key() -> Column:
    return F.struct("z", F.col("doc_id").isNotNull().alias("some"), "doc_id", "size")


def _cell(cells: int) -> Column:
    return F.least(F.floor(F.col("z") * cells), F.lit(cells - 1)).cast("int")


def _edges(tied: DataFrame, cells: int) -> DataFrame:
    """``(edge_source, cell_from, cut, gap)``: how far the ranks fit below ``wanted``, and the words missing."""
    per_cell = tied.groupBy("source", "wanted", "cell").agg(F.sum("words").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("cell")
                                            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = per_cell.withColumn("before", before).where("before < wanted").groupBy("source", "wanted").agg(
        F.max(F.struct("cell", "before")).alias("e"))
    edge = edge.select(F.col("source").alias("edge_source"), F.col("wanted").alias("edge_wanted"),
                       F.col("e.cell").alias("edge_cell"), F.col("e.before").alias("before"))
    inner = tied.join(edge, tied["source"].eqNullSafe(edge["edge_source"]) & (tied["cell"] == edge["edge_cell"]))
    upto = F.col("before") + F.sum("words").over(
        Window.partitionBy("source").orderBy("z", F.col("doc_id").asc_nulls_first(), "size"))
    inner = inner.withColumn("upto", upto).where("upto <= wanted")
    at = inner.groupBy("source").agg(F.max(_key()).alias("cut"), F.max("upto").alias("upto"))
    return edge.join(at, edge["edge_source"].eqNullSafe(at["source"]), "left").select(
        "edge_source", (F.col("edge_cell") / float(cells)).alias("cell_from"), "cut",
        (F.col("edge_wanted") - F.coalesce("upto", "before")).alias("gap"))


def cuts(ranked: DataFrame, cells: int = CELLS) -> DataFrame:
    """Per source: the last key that fits below the wanted words, and one more that fills the gap best.

    ``cut`` is null where the edge cell takes nothing: all cells below
    ``cell_from`` are taken then.  ``extra`` is the key outside whose words
    come nearest to what is still missing, null where adding it brings nothing.
    """
    r = ranked.where("wanted > 0 and size > 0")
    # rows of one rank, id and size tie and count together
    tied = r.groupBy("source", "wanted", _cell(cells).alias("cell"), "z", "doc_id", "size").agg(F.sum("size").alias("words"))
    tied = written(tied, "ranks")
    edge = written(_edges(tied, cells), "edges")
    beyond = tied.join(edge, tied["source"].eqNullSafe(edge["edge_source"])).where(~_below())
    miss = F.abs(F.col("words") - F.col("gap"))
    extra = beyond.where(miss < F.col("gap")).groupBy("source").agg(
        F.min(F.struct(miss.alias("miss"), _key().alias("extra")))["extra"].alias("extra"))
    return edge.join(extra, edge["edge_source"].eqNullSafe(extra["source"]), "left").select(
        F.col("edge_source").alias("source"), "cell_from", "cut", "extra")


def rounds(tied: DataFrame, seed: str, cells: int = CELLS) -> DataFrame:
    """``(source, steps, extra)`` of draws repeated until no document left fits the words still wanted.

    ``tied`` has ``source, wanted, doc_id, size, words``, a row per tie.  A step
    holds what its draw needs to be made again on a row: the words ``wanted``
    before it, the sum of squared sizes it drew from, and its cut.  What a
    round leaves is less than the document that it stopped at, and the order is
    random, so a round leaves a fraction of the words and rounds are few.
    """
    rest = written(tied.withColumn("u", _uniform(F.col("doc_id"), seed)), "rest")
    steps = []
    while True:
        fits = F.col("words") <= F.col("wanted")
        drawn = written(rest.where(fits).groupBy(F.col("source").alias("step_source"), F.col("wanted").alias("step_wanted")).agg(
            F.sum(F.col("size").cast("decimal(19,0)") * F.col("words")).cast("double").alias("squares")), "drawn")
        if drawn.isEmpty():
            break
        r = rest.join(drawn, rest["source"].eqNullSafe(drawn["step_source"]), "left")
        r = r.withColumn("z", F.when(fits, _rank(F.col("wanted"), F.col("squares"), F.col("u"))))
        r = written(r.withColumn("cell", _cell(cells)).drop("step_source", "step_wanted", "squares"), "ranks")
        edge = written(_edges(r.where("z is not null"), cells), "edges")
        steps.append(drawn.join(edge, drawn["step_source"].eqNullSafe(edge["edge_source"])).select(
            F.col("step_source").alias("source"), F.struct(
                F.lit(len(steps)).alias("step"), F.col("step_wanted").alias("wanted"), "squares", "cell_from", "cut").alias("s")))
        left = r.join(edge, r["source"].eqNullSafe(edge["edge_source"]), "left")
        # a document that did not fit has no rank: a struct with a null sorts first, but it is not below
        left = left.where(F.col("z").isNull() | ~_below()).withColumn("wanted", F.coalesce("gap", "wanted"))
        # nothing of twice the words wanted can fit later or bring the sum nearer
        rest = written(left.where(F.col("words") < 2 * F.col("wanted")).select(*rest.columns), "rest")
    miss = F.abs(F.col("words") - F.col("wanted"))
    extra = rest.where(miss < F.col("wanted")).groupBy(F.col("source").alias("extra_source")).agg(
        F.min(F.struct(miss.alias("miss"), "u", F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "size").alias("extra")))["extra"].alias("extra"))
    if not steps:
        return extra.select(F.col("extra_source").alias("source"), F.lit(None).cast(_steps_type(tied)).alias("steps"), "extra")
    every = steps[0]
    for one in steps[1:]:
        every = every.unionByName(one)
    # a row per source and round
    every = every.groupBy("source").agg(F.sort_array(F.collect_list("s")).alias("steps"))
    return every.join(extra, every["source"].eqNullSafe(extra["extra_source"]), "full").select(
        F.coalesce("source", "extra_source").alias("source"), "steps", "extra")


def _steps_type(tied: DataFrame) -> str:
    kind = tied.schema["doc_id"].dataType.simpleString()
    return ("array<struct<step:int,wanted:double,squares:double,cell_from:double,"
            f"cut:struct<z:double,some:boolean,doc_id:{kind},size:bigint>>>")


def _below() -> Column:
    return F.when(F.col("cut").isNotNull(), _key() <= F.col("cut")).otherwise(F.col("z") < F.col("cell_from"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED, fill: bool = False) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` and the row's columns as ``in_0, in_1, ...``."""
    sized = written(sizes(docs, id_col, text_col, source_col), "sizes")
    plan = written(allocate(sized, weights, max_repeats), "plan")
    d, new, old = apart(docs)
    d = d.withColumns({"doc_id": F.col(new[old.index(id_col)]), "source": F.col(new[old.index(source_col)]),
                       "size": word_count(F.col(new[old.index(text_col)]))})
    r = (_filled if fill else _drawn)(d, sized, plan, seed)
    r = r.withColumn("copies", F.col("certain") + F.when(F.col("drawn"), 1).otherwise(0))
    return r.select(*new, "doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken"))


def _with_cuts(plan: DataFrame, cut: DataFrame) -> DataFrame:
    cut = written(cut, "cuts").withColumnRenamed("source", "cut_source")
    return written(plan.join(cut, plan["source"].eqNullSafe(F.col("cut_source")), "left").drop("cut_source"), "plan")


def _drawn(d: DataFrame, sized: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """``d`` with its plan and whether the single draw takes the row."""
    plan = _with_cuts(plan, cuts(_ranked(sized, plan, seed)))
    # no cut, no draw: nothing is wanted beyond the certain copies
    drawn = F.col("cell_from").isNotNull() & (F.col("size") > 0) & (
        _below() | F.coalesce(_key() == F.col("extra"), F.lit(False)))
    return _ranked(d, plan, seed).withColumn("drawn", drawn)


def _filled(d: DataFrame, sized: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """``d`` with its plan and whether a round takes the row."""
    tied = _planned(sized, plan).where("wanted > 0 and size > 0").groupBy("source", "wanted", "doc_id", "size").agg(
        F.sum("size").alias("words"))
    tied = written(tied, "ties")
    d = _planned(d, _with_cuts(plan, rounds(tied, seed)))
    twins = tied.where("words > size").select(F.col("source").alias("t_source"), F.col("doc_id").alias("t_id"),
                                              F.col("size").alias("t_size"), "words")
    n_twins = twins.count()
    if not n_twins:
        d = d.withColumn("words", F.col("size"))
    else:
        d = d.join(by_key(twins, n_twins), d["source"].eqNullSafe(F.col("t_source")) & d["doc_id"].eqNullSafe(F.col("t_id"))
                   & (d["size"] == F.col("t_size")), "left").withColumn("words", F.coalesce("words", "size"))
    d = d.withColumn("u", _uniform(F.col("doc_id"), seed))

    def takes(s: Column) -> Column:
        z = _rank(s["wanted"], s["squares"], F.col("u"))
        key = F.struct(z.alias("z"), F.col("doc_id").isNotNull().alias("some"), "doc_id", "size")
        return (F.col("words") <= s["wanted"]) & F.when(s["cut"].isNotNull(), key <= s["cut"]).otherwise(z < s["cell_from"])

    key = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "size")
    drawn = F.coalesce(F.exists("steps", takes), F.lit(False)) | F.coalesce(key == F.col("extra"), F.lit(False))
    return d.withColumn("drawn", (F.col("size") > 0) & drawn)


def repeat(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row as many times as the mix takes it; options as for ``mix``."""
    old = docs.columns
    m = mix(docs, **options)
    new = [f"in_{i}" for i in range(len(old))]
    return m.where("copies > 0").select(*new, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(*new).toDF(*old)
