"""Evaluation of retrieval runs over result rows and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import spread


def precision_recall(evidence: DataFrame) -> DataFrame:
    """qid, n_pred, n_gold, precision, recall, recall_entailed.  Sets; one aggregate by question and triple, no join.

    A gold triple is entailed if its two names occur together, in either direction, in a predicted one."""
    pair = F.concat_ws("|", F.least("h", "u"), F.greatest("h", "u"))
    edge = evidence.groupBy("qid", "h", "r", "u", pair.alias("pair")).agg(F.max(F.col("side") == "pred").alias("p"), F.max(F.col("side") == "gold").alias("g"))
    pairs = edge.groupBy("qid", "pair").agg(F.count_if("p").alias("p"), F.count_if("g").alias("g"), F.count_if(F.col("p") & F.col("g")).alias("b"))
    n = pairs.groupBy("qid").agg(F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold"), F.sum("b").alias("both"), F.sum(F.when(F.col("p") > 0, F.col("g")).otherwise(0)).alias("near"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(F.lit(0.0))
    return n.select("qid", "n_pred", "n_gold", share("both", "n_pred").alias("precision"), share("both", "n_gold").alias("recall"), share("near", "n_gold").alias("recall_entailed"))


def summary(results: DataFrame, *by: str) -> DataFrame:
    """Counts and means (population deviations) by run, or by run and type."""
    flag = F.col("correct").cast("double")
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(flag), 6).alias("acc"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("n_calls"), 6).alias("calls_mean"), F.round(F.stddev_pop("n_calls"), 6).alias("calls_sd"), F.round(F.avg("seconds"), 5).alias("seconds_mean"), F.round(F.stddev_pop("seconds"), 5).alias("seconds_sd"))


def by_type(results: DataFrame, types: list[str]) -> DataFrame:
    """run and a column of accuracy for each type."""
    return results.groupBy("run").pivot("type", types).agg(F.round(F.avg(F.col("correct").cast("double")), 6))


def paired(results: DataFrame, a: str, b: str) -> DataFrame:
    """n, only_a, only_b and z of two runs over their common questions: a pivot by question instead of a join."""
    own = results.where(F.col("run").isin(a, b)).groupBy("qid").agg(F.max(F.when(F.col("run") == a, F.col("correct"))).alias("a"), F.max(F.when(F.col("run") == b, F.col("correct"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    n = own.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"))
    return n.withColumn("z", F.when(F.col("only_a") + F.col("only_b") > 0, F.round((F.col("only_a") - F.col("only_b")) / F.sqrt(F.col("only_a") + F.col("only_b")), 6)).otherwise(F.lit(0.0)))


def error_kinds(results: DataFrame) -> DataFrame:
    return results.where("error IS NOT NULL").groupBy("run", F.substring_index("error", ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def failed(results: DataFrame) -> DataFrame:
    """Rows with an error, or whose answer says that its generation failed."""
    return results.where("error IS NOT NULL OR coalesce(contains(answer, 'generation failed'), false)").select("run", "qid")


def seconds_per_call(results: DataFrame) -> DataFrame:
    per = F.col("seconds") / F.col("n_calls")
    return results.where("n_calls > 0").groupBy("run").agg(F.round(F.avg(per), 5).alias("mean"), F.round(F.stddev_pop(per), 5).alias("sd"))


def repaired(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of an old run, with those that failed replaced by the new run's rows of the same question."""
    bad = old.where("error IS NOT NULL").select("qid")
    return old.where("error IS NULL").unionByName(new.join(bad, "qid", "left_semi"))


def reused(prior: DataFrame, items: DataFrame, stale: DataFrame, named: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows kept, items left to score).  A whole run keeps the rows of its items that are not stale.  A repair of named
    rows keeps every row that it does not name, stale or not, and scores the named ones again."""
    if named is not None:
        return prior.join(named.select("qid"), "qid", "left_anti"), items.join(named.select("qid"), "qid", "left_semi")
    good = prior.join(stale.select("qid"), "qid", "left_anti")
    return good.join(items.select("qid"), "qid", "left_semi"), items.join(good.select("qid"), "qid", "left_anti")


def common(*arms: DataFrame) -> DataFrame:
    """Questions (qid) that every arm has: one mask by question, however many arms there are.  Rows are dealt by question
    before they are grouped, so that no task holds the questions of a whole file."""
    every = None
    for i, arm in enumerate(arms):
        part = arm.select("qid", F.lit(1 << i).alias("arm"))
        every = part if every is None else every.unionByName(part)
    return spread(every, "qid").groupBy("qid").agg(F.bit_or("arm").alias("n")).where(F.col("n") == (1 << len(arms)) - 1).select("qid")


def remaining(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items that have no row yet."""
    return items.join(done, "qid", "left_anti")


def check(results: DataFrame, split: DataFrame) -> DataFrame:
    """run, n, duplicates, missing, extra: whether each run has the split's questions, once each."""
    own = results.groupBy("run", "qid").agg(F.count(F.lit(1)).alias("c"))
    flag = own.join(split.select("qid", F.lit(1).alias("s")), "qid", "left")
    n = flag.groupBy("run").agg(F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("duplicates"), F.count_if(F.col("s").isNull()).alias("extra"), F.count("s").alias("found"))
    total = split.agg(F.count(F.lit(1)).alias("total"))
    return n.join(F.broadcast(total), F.lit(True)).select("run", "n", "duplicates", "extra", (F.col("total") - F.col("found")).alias("missing"))


def cases(results: DataFrame, run: str, beaten: int = 2, most: int = 20) -> DataFrame:
    """Questions that `run` has right and at least `beaten` other runs have wrong, best recall first."""
    own = results.groupBy("qid").agg(F.max(F.when(F.col("run") == run, F.col("correct"))).alias("mine"), F.max(F.when(F.col("run") == run, F.col("recall"))).alias("recall"), F.count_if((F.col("run") != run) & ~F.col("correct")).alias("wrong"))
    return own.where(F.col("mine") & (F.col("wrong") >= beaten)).orderBy(F.desc("recall"), "qid").limit(most).select("qid", "recall", "wrong")


def composition(items: DataFrame) -> DataFrame:
    """By type, and over all (type ALL): items, visual ones, mean hops, mean words of question and answer, and the share
    that is solved without evidence.  One pass; items: type, multimodal, hops, question, answer, solved."""
    words = lambda c: F.size(F.split(F.trim(c), r"\s+"))
    every = items.select(F.explode(F.array("type", F.lit("ALL"))).alias("type"), "multimodal", "hops", words("question").alias("q"), words("answer").alias("a"), "solved")
    mean = lambda c: F.round(F.avg(c), 5)
    return every.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if("multimodal").alias("visual"), mean("hops").alias("hops"), mean("q").alias("question_words"), mean("a").alias("answer_words"), mean(F.col("solved").cast("double")).alias("solved"))


def ablation(results: DataFrame, base: str) -> DataFrame:
    """run, n, acc, precision, recall, calls, delta (accuracy less the base run's) and z of the paired difference to it,
    over the questions that both have.  The base run is one more column of each question, not a join of runs."""
    own = results.withColumn("b", F.max(F.when(F.col("run") == base, F.col("correct").cast("int"))).over(W.partitionBy("qid")) == 1)
    up, down = F.count_if(F.col("correct") & ~F.col("b")), F.count_if(~F.col("correct") & F.col("b"))
    mean = lambda c: F.round(F.avg(c), 6)
    flag = F.col("correct").cast("double")
    out = own.groupBy("run").agg(F.count(F.lit(1)).alias("n"), mean(flag).alias("acc"), mean("precision").alias("precision"), mean("recall").alias("recall"), mean("n_calls").alias("calls"), F.round(F.avg(flag) - F.avg(F.when(F.col("b").isNotNull(), F.col("b").cast("double"))), 6).alias("delta"), up.alias("up"), down.alias("down"))
    return out.select("run", "n", "acc", "precision", "recall", "calls", "delta", F.when(F.col("up") + F.col("down") > 0, F.round((F.col("up") - F.col("down")) / F.sqrt(F.col("up") + F.col("down")), 6)).otherwise(F.lit(0.0)).alias("z"))


def home_field(results: DataFrame) -> DataFrame:
    """scope, n, margin of one backbone over the other on either wording, and the difference of the margins, over the
    questions that all four arms have.  results: qid, type, backbone (1, 2), wording (1, 2), correct."""
    arm = lambda b, w: F.max(F.when((F.col("backbone") == b) & (F.col("wording") == w), F.col("correct").cast("int")))
    wide = results.groupBy("qid").agg(F.max("type").alias("type"), *(arm(b, w).alias(f"a{b}{w}") for b in (1, 2) for w in (1, 2))).dropna()
    scopes = wide.select("*", F.explode(F.when(F.col("type") == "mm_chain", F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("without mm_chain")))).alias("scope"))
    margin = lambda w: F.avg(F.col(f"a1{w}") - F.col(f"a2{w}"))
    return scopes.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.round(margin(1), 6).alias("margin_1"), F.round(margin(2), 6).alias("margin_2"), F.round(margin(1) - margin(2), 6).alias("advantage"))


def verified(results: DataFrame, summaries: DataFrame, split: DataFrame, tolerance: float = 5e-5) -> DataFrame:
    """run, rows, stated, duplicates, extra, missing and which means differ by more than the tolerance from those that
    the summary (run, n, acc, precision, recall) states."""
    counts = check(results, split).withColumnRenamed("n", "rows")
    flag = F.col("correct").cast("double")
    means = results.groupBy("run").agg(F.avg(flag).alias("m_acc"), F.avg("precision").alias("m_precision"), F.avg("recall").alias("m_recall"))
    own = counts.join(means, "run").join(summaries, "run", "left")
    bad = F.concat_ws(",", *(F.when(F.abs(F.col(c) - F.col(f"m_{c}")) > tolerance, F.lit(c)) for c in ("acc", "precision", "recall")))
    return own.select("run", "rows", F.col("n").alias("stated"), "duplicates", "extra", "missing", bad.alias("wrong_means"))


def rejudged(results: DataFrame, items: DataFrame, judge) -> DataFrame:
    """Rows with a new verdict; those whose question is gone go, and rows with an error stay wrong.  judge: a function of
    the columns question, answer, atoms and candidate that gives a boolean column (a provider's, or a rule)."""
    own = results.drop("correct").join(items.select("qid", "question", F.col("answer").alias("reference"), "atoms"), "qid")
    verdict = F.coalesce(judge(F.col("question"), F.col("reference"), F.col("atoms"), F.col("answer")), F.lit(False))
    return own.withColumn("correct", F.col("error").isNull() & verdict).drop("question", "reference", "atoms")


def names_all(question, reference, atoms, candidate):
    """The offline judge: a candidate is right if it holds every atom of the answer."""
    low = F.lower(F.coalesce(candidate, F.lit("")))
    return F.forall(atoms, lambda a: F.contains(low, F.lower(a)))


def masked(images: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """Images (path, caption, ...) with the captions of hidden paths blanked; without `hidden`, of all."""
    if hidden is None:
        return images.withColumn("caption", F.lit(""))
    gone = hidden.select("path", F.lit(True).alias("_hide")).distinct()
    return images.join(gone, "path", "left").withColumn("caption", F.when(F.col("_hide"), F.lit("")).otherwise(F.coalesce("caption", F.lit("")))).drop("_hide")


def sweep_name(name):
    """budget, depth and k in a run's name like dev-b5d4k16."""
    return [F.regexp_extract(name, r"dev-b(\d+)d(\d+)k(\d+)", i).try_cast("int").alias(c) for i, c in enumerate(("budget", "depth", "k"), 1)]
