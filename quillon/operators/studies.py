"""Pieces of studies: audits of drafts, cross-validation by cold groups, cross-fitting, refuters, bounded retries, acquisition in rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import hash_unit
from quillon.io import checkpointed
from quillon.operators import causal, metrics

ELEMENTS = ["C", "N", "O", "S", "P"]  # fixed values
HALOGENS = ["F", "Cl", "Br", "I"]
_ATOM = r"\[(?:[A-Z][a-z]?|[cnops])[^\]]*\]|Cl|Br|Si|Se|[BCNOFPSI]|[cnops]"


# ---- strings of atoms ----


def string_descriptors(smiles: Column) -> dict[str, Column]:
    """Fifteen descriptors of a string of atoms; shares are null where it holds none."""
    raw = F.transform(F.regexp_extract_all(smiles, F.lit(f"({_ATOM})"), F.lit(1)), lambda m: F.regexp_extract(m, r"^\[?(Cl|Br|Si|Se|[A-Z][a-z]?|[cnops])", 1))
    aromatic = F.filter(raw, lambda t: F.rlike(t, F.lit("^[cnops]$")))
    atoms = F.transform(raw, lambda t: F.when(F.rlike(t, F.lit("^[cnops]$")), F.upper(t)).otherwise(t))
    count = lambda names: F.size(F.filter(atoms, lambda t: t.isin(names)))
    share = lambda n: F.try_divide(n.cast("double"), F.size(atoms))
    chars = lambda pattern: (F.length(smiles) - F.length(F.regexp_replace(smiles, pattern, ""))).cast("long")
    known = count([*ELEMENTS, *HALOGENS])
    return {
        "length": F.length(smiles), "n_atoms": F.size(atoms), **{f"share_{e.lower()}": share(count([e])) for e in ELEMENTS}, "share_halogen": share(count(HALOGENS)),
        "share_other": share(F.size(atoms) - known), "share_aromatic": share(F.size(aromatic)), "n_ring_marks": chars("[0-9]"), "n_branches": chars(r"\("), "n_double": chars("="),
        "n_triple": chars("#"), "n_charges": chars(r"[+\-]"),
    }


# ---- drafts ----


def audit_drafts(drafts: DataFrame, draft: str, text: str, finalizable: DataFrame, analysis: DataFrame, titles: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Findings (draft, code, severity, subject): claims [A1] that the ledger can't finalise, metrics name=value that the saved analysis lacks or has otherwise, exact titles of sources, drafts without claims.

    finalizable: claim; analysis: name, value; titles: title (those of under 12 characters are no findings).
    """
    d = drafts.select(F.col(draft).alias("draft"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = lambda pattern, group: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    claims = d.select("draft", F.explode(F.array_distinct(found(r"\[([A-Za-z]\d+)\]", 1))).alias("claim"))
    unsupported = claims.join(finalizable, "claim", "left_anti").select("draft", F.lit("unsupported_claim").alias("code"), F.lit("error").alias("severity"), F.col("claim").alias("subject"))
    metric = r"\b([A-Za-z_][A-Za-z0-9_]*)=(-?\d+(?:\.\d+)?)"
    numbers = d.select("draft", F.explode(F.arrays_zip(found(metric, 1).alias("name"), found(metric, 2).alias("given"))).alias("m")).select("draft", "m.name", F.col("m.given").cast("double").alias("given"))
    judged = numbers.join(analysis, "name", "left")
    wrong = judged.where(F.col("value").isNull() | (F.abs(F.col("given") - F.col("value")) > tolerance))
    code = F.when(F.col("value").isNull(), "unknown_numeric_claim").otherwise("numeric_mismatch")
    wrong = wrong.select("draft", code.alias("code"), F.lit("error").alias("severity"), F.col("name").alias("subject"))
    untraced = d.where(F.size(found(r"\[([A-Za-z]\d+)\]", 1)) == 0).select("draft", F.lit("missing_claim_trace").alias("code"), F.lit("warning").alias("severity"), F.lit("").alias("subject"))
    named = titles.where(F.length("title") >= 12).agg(F.collect_set("title").alias("titles"))  # the titles of a ledger's sources, in one row
    copied = d.crossJoin(F.broadcast(named)).select("draft", F.explode(F.filter("titles", lambda t: F.contains(F.lower("text"), F.lower(t)))).alias("subject"))
    copied = copied.select("draft", F.lit("source_phrase_overlap").alias("code"), F.lit("warning").alias("severity"), "subject")
    return unsupported.unionByName(wrong).unionByName(copied).unionByName(untraced)


# ---- folds of whole groups ----


def cold_folds(df: DataFrame, group: str, folds: int, seed: str) -> DataFrame:
    """Adds fold: all rows of a group share one."""
    return df.withColumn("fold", (hash_unit(F.lit(seed), F.col(group).cast("string")) % folds).cast("int"))


def out_of_fold_rates(folded: DataFrame, key: str, category: str, label: str) -> DataFrame:
    """key, fold, label, score: the rate of the row's category in the other folds, or their whole rate where they lack it."""
    by = folded.groupBy(category, "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("s"))
    fold = by.groupBy("fold").agg(F.sum("n").alias("n_fold"), F.sum("s").alias("s_fold"))
    whole = fold.agg(F.sum("n_fold").alias("n_all"), F.sum("s_fold").alias("s_all"))
    cats = by.groupBy(category).agg(F.sum("n").alias("n_cat"), F.sum("s").alias("s_cat"))
    rates = by.join(cats, category).join(F.broadcast(fold), "fold").crossJoin(F.broadcast(whole))  # a row for each fold; one row
    own = F.try_divide(F.col("s_cat") - F.col("s"), (F.col("n_cat") - F.col("n")).cast("double"))
    prior = F.try_divide(F.col("s_all") - F.col("s_fold"), (F.col("n_all") - F.col("n_fold")).cast("double"))
    return folded.join(rates.select(category, "fold", F.coalesce(own, prior).alias("score")), [category, "fold"]).select(key, "fold", F.col(label).alias("label"), "score")


def fold_report(scores: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """Confusion and rates by keys."""
    return metrics.confusion_by(scores, keys, F.col("label") == 1, F.col("score") >= threshold)


def check_folds(folds: DataFrame, key: str, whole: DataFrame) -> DataFrame:
    """Of fold-indexed rows (fold, part, key): rows that a fold's train and test share, rows that are in no fold's test or in several, and keys that the whole table lacks."""
    test, train = folds.where("part = 'test'").select("fold", key), folds.where("part = 'train'").select("fold", key)
    times = test.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    shared, several = one(train.intersect(test), "n_shared"), one(times.where("n > 1"), "n_several")
    missing, unknown = one(whole.select(key).join(times, key, "left_anti"), "n_untested"), one(folds.select(key).distinct().join(whole.select(key), key, "left_anti"), "n_unknown")
    out = shared.crossJoin(several).crossJoin(missing).crossJoin(unknown)  # one row each
    return out.withColumn("sound", F.col("n_shared") + F.col("n_several") + F.col("n_untested") + F.col("n_unknown") == 0)


def fold_inputs(folds: DataFrame, rows: DataFrame, key: str, fold: int) -> tuple[DataFrame, DataFrame]:
    """The train and test rows of one fold of a bundle (fold, part, key); a fold without either is refused."""
    mine = folds.where(F.col("fold") == fold)
    train, test = (rows.join(mine.where(F.col("part") == part).select(key), key, "left_semi") for part in ("train", "test"))
    if not train.limit(1).count() or not test.limit(1).count():
        raise ValueError(f"fold {fold} is not whole")
    return train, test


# ---- effects ----


def cross_fitted(df: DataFrame, key: str, stratum: str, folds: int, seed: str, t: str = "t", y: str = "y") -> DataFrame:
    """df with p, m0 and m1 of each row's stratum, all from the other folds (their whole means where the stratum lacks an arm)."""
    folded = cold_folds(df, key, folds, seed)
    sums = [F.count(F.lit(1)).alias("n"), F.sum(t).alias("n1"), F.sum(F.when(F.col(t) == 1, F.col(y))).alias("y1"), F.sum(F.when(F.col(t) == 0, F.col(y))).alias("y0")]
    names = ["n", "n1", "y1", "y0"]
    cells = folded.groupBy(stratum, "fold").agg(*sums).na.fill(0.0, ["y1", "y0"])
    total = lambda *by: cells.groupBy(*by).agg(*[F.sum(c).alias(c) for c in names])
    left = cells.join(total(stratum).select(stratum, *[F.col(c).alias(f"s_{c}") for c in names]), stratum)
    left = left.join(total("fold").select("fold", *[F.col(c).alias(f"f_{c}") for c in names]), "fold").crossJoin(total().select(*[F.col(c).alias(f"a_{c}") for c in names]))  # one row
    here, there = ({c: F.col(f"{a}_{c}") - F.col(b) for c, b in ((c, c if a == "s" else f"f_{c}") for c in names)} for a in ("s", "a"))

    def rate(top: str, below) -> Column:
        return F.coalesce(F.try_divide(here[top].cast("double"), below(here)), F.try_divide(there[top].cast("double"), below(there)))

    fitted = left.select(stratum, "fold", rate("n1", lambda c: c["n"]).alias("p"), rate("y1", lambda c: c["n1"]).alias("m1"), rate("y0", lambda c: c["n"] - c["n1"]).alias("m0"))
    return folded.join(fitted, [stratum, "fold"])


def stratified_effect(df: DataFrame, stratum: list[str], by: list[str], t: str = "t", y: str = "y") -> DataFrame:
    """Difference of arm means, standardised to the strata that have both arms; one row for each of ``by``."""
    arms = df.groupBy(*by, *stratum).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col(t) == 1, F.col(y))).alias("y1"), F.avg(F.when(F.col(t) == 0, F.col(y))).alias("y0"))
    both = arms.where("y1 is not null and y0 is not null")
    effect = (F.sum(F.col("n") * (F.col("y1") - F.col("y0"))) / F.sum("n")).alias("effect")
    return both.groupBy(*by).agg(effect) if by else both.agg(effect)


def refute(df: DataFrame, key: str, stratum: str, replicates: int, share: float = 0.8, seed: str = "refute") -> DataFrame:
    """check, effect (mean over replicates), spread (largest distance from the estimate), and the estimate itself: a placebo treatment of the same rate, a random common cause of three levels, and random subsets."""
    rows = df.select(key, "t", "y", F.col(stratum).cast("string").alias("stratum"))
    rate = rows.agg(F.avg("t").alias("rate"))
    copies = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    draw = lambda name: hash_unit(F.lit(f"{seed}-{name}"), F.col("rep").cast("string"), F.col(key).cast("string"))
    placebo = copies.crossJoin(F.broadcast(rate)).withColumn("t", (draw("placebo") / F.lit(2.0**32) < F.col("rate")).cast("int"))  # one row
    cause = copies.withColumn("cause", draw("cause") % 3)
    subset = copies.where(draw("subset") / F.lit(2.0**32) < share)
    checks = {"placebo": stratified_effect(placebo, ["stratum"], ["rep"]), "random_common_cause": stratified_effect(cause, ["stratum", "cause"], ["rep"]), "subset": stratified_effect(subset, ["stratum"], ["rep"])}
    found = None
    for name, effects in checks.items():
        part = effects.select(F.lit(name).alias("check"), "effect")
        found = part if found is None else found.unionByName(part)
    estimate = stratified_effect(rows, ["stratum"], []).withColumnRenamed("effect", "estimate")
    both = found.crossJoin(F.broadcast(estimate))  # one row
    return both.groupBy("check", "estimate").agg(F.avg("effect").alias("effect"), F.max(F.abs(F.col("effect") - F.when(F.col("check") == "placebo", 0.0).otherwise(F.col("estimate")))).alias("spread"))


# ---- rounds ----


def repair_loop(tasks: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], key: str, most: int, journal: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Attempts of all tasks, each tried until it succeeds or ``most`` times: attempt(open tasks, iteration) gives key, success and more. Each round's attempts are written before the next begins, and passed to the journal."""
    still, found = tasks, None
    for iteration in range(1, most + 1):
        made = checkpointed(attempt(still, iteration).withColumn("iteration", F.lit(iteration)))
        if journal is not None:
            journal(made)
        found = made if found is None else found.unionByName(made)
        still = checkpointed(still.join(made.where("success").select(key), key, "left_anti"))
        if not still.limit(1).count():
            break
    return found


def run_study(tasks: DataFrame, arms: dict[str, Callable[[DataFrame], DataFrame]], key: str, cost: str, cap: float, journal: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Attempts of all arms, one arm after the other and by key in an arm, as far as the running cost stays within the cap: arm, the attempts' columns and spent (cost so far).

    An arm's attempts are written before the next begins, and passed to the journal; no arm begins once the cap is reached. Running costs add up inside ranges of the key first.
    """
    found, spent = None, 0.0
    for name, attempt in arms.items():
        made = checkpointed(attempt(tasks).withColumn("arm", F.lit(name)))
        upto = running_total(made, key, cost).withColumn("spent", F.col("_total") + F.lit(spent)).drop("_total")
        kept = checkpointed(upto.where(F.col("spent") <= cap))
        if journal is not None:
            journal(kept)
        found = kept if found is None else found.unionByName(kept)
        total = made.agg(F.coalesce(F.sum(cost), F.lit(0.0))).first()[0]
        spent += float(total)
        if spent >= cap:
            break
    return found


def running_total(df: DataFrame, key: str, value: str) -> DataFrame:
    """Adds _total: the sum of value over rows up to this one in the order of a unique key."""
    parts = checkpointed(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_s"))
    before = sums.withColumn("_before", F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).drop("_s")  # a row for each range
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(F.broadcast(before), "_part").withColumn("_total", F.col("_before") + inside).drop("_part", "_before")


def counterexample(spark: SparkSession, names: list[str], numerators: list[int], denominator: int, holds: str, observed: str) -> DataFrame:
    """The first point of a grid of fractions at which a claim fails: numerators of each variable, and the observed value.

    Variables are the numerators over one denominator (d in the expressions), so claims in whole numbers (holds and observed, SQL over names and d) are exact. The grid is a range; no point is a row before it is tested.
    """
    n = len(numerators)
    values = F.array(*[F.lit(v).cast("long") for v in numerators])
    grid = spark.range(n ** len(names))
    for k, name in enumerate(names):  # the last variable changes fastest
        grid = grid.withColumn(name, F.get(values, (F.floor(F.col("id") / n ** (len(names) - 1 - k)) % n).cast("int")))
    failing = grid.withColumn("d", F.lit(denominator).cast("long")).where(f"NOT ({holds})").withColumn("observed", F.expr(observed))
    first = failing.agg(F.min_by(F.struct(*names, "d", "observed"), "id").alias("p")).where("p IS NOT NULL")
    return first.select("p.*")


def acquire(pool: DataFrame, key: str, first: int, batch: int, rounds: int, score: Callable[[DataFrame, DataFrame], Column], seed: str) -> DataFrame:
    """Active learning in rounds: a hash-ordered start, then in each round the ``batch`` of greatest score (ties by hash, then key) among the rest; score(pool, chosen) may look at what is chosen. Gives key, round and place.

    A random policy is a score of ``F.lit(0)``. A round is a top-k of the pool; what is chosen is first + rounds * batch rows.
    """
    order = hash_unit(F.lit(seed), F.col(key).cast("string"))
    rest = pool.withColumn("_h", order)
    start = rest.orderBy("_h", key).limit(first).select(key, F.lit(0).alias("round"), F.col("_h").alias("_tie"), F.lit(0.0).alias("_score"))
    chosen = checkpointed(start)
    for r in range(1, rounds + 1):
        left = rest.join(F.broadcast(chosen.select(key)), key, "left_anti")  # as many rows as were chosen
        taken = left.withColumn("_score", score(pool, chosen).cast("double")).orderBy(F.desc("_score"), "_h", key).limit(batch)
        chosen = checkpointed(chosen.unionByName(taken.select(key, F.lit(r).alias("round"), F.col("_h").alias("_tie"), "_score")))
    place = F.row_number().over(Window.partitionBy("round").orderBy(F.desc("_score"), "_tie", key))
    return chosen.select(key, "round", place.alias("place"))


# ---- evidence ----

NEGATIONS = ["not", "no", "never", "without", "nicht", "kein", "ne", "pas", "sans", "nunca", "sin"]


def verify_claims(hits: DataFrame, claims: DataFrame, sentences: DataFrame, sentence_threshold: float, most: int, assertion_threshold: float) -> DataFrame:
    """claim, verdict, doc_id, sentences and confidence of each claim: retrieve, stance, sentences, decision.

    hits: claim, doc_id, rank, strength (0 to 1); claims: claim, tokens; sentences: doc_id, sid, tokens. A sentence's score is the share of the claim's tokens that it holds;
    of each document the ``most`` best at or above the threshold are cited. A document contradicts where exactly one of claim and best sentence holds a negation. Confidence is the root of strength times best score;
    the best document (rank, then id, tell equals apart) decides if its confidence reaches the threshold.
    """
    negated = lambda c: F.arrays_overlap(c, F.array(*map(F.lit, NEGATIONS)))
    scored = hits.join(claims, "claim").join(sentences.withColumnRenamed("tokens", "held"), "doc_id")
    scored = scored.withColumn("score", F.size(F.array_intersect("tokens", "held")) / F.size("tokens")).where(F.col("score") >= sentence_threshold)
    w = Window.partitionBy("claim", "doc_id").orderBy(F.desc(F.round("score", 9)), "sid")
    cited = scored.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    per = cited.groupBy("claim", "doc_id", "rank", "strength").agg(
        F.array_join(F.sort_array(F.collect_list("sid")), ",").alias("sentences"), F.max("score").alias("best"), F.min_by(negated(F.col("held")) != negated(F.col("tokens")), "k").alias("against"),
    )
    judged = per.withColumn("confidence", F.sqrt(F.col("strength") * F.col("best")))
    top = judged.groupBy("claim").agg(F.min_by(F.struct("doc_id", "sentences", "against", "confidence"), F.struct(-F.round("confidence", 6), "rank", "doc_id")).alias("b"))
    all_claims = claims.select("claim").join(top, "claim", "left")
    sure = F.col("b.confidence") >= assertion_threshold
    verdict = F.when(~F.coalesce(sure, F.lit(False)), "NOT_ENOUGH_INFO").when(F.col("b.against"), "CONTRADICT").otherwise("SUPPORT")
    return all_claims.select("claim", verdict.alias("verdict"), F.when(sure, F.col("b.doc_id")).alias("doc_id"), F.when(sure, F.col("b.sentences")).alias("sentences"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"))
