"""Scores of predicted spans against gold ones. Relations: spans (doc_id, label, start, end[, score]), half-open."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .combine import covered, shared_chars

MATCH_IOU = 0.5


def f_beta(hit: Column, gold: Column, predicted: Column, beta: float) -> Column:
    """Of ratios of sums; 0 where nothing is right."""
    return F.coalesce(F.try_divide((1 + beta * beta) * hit, beta * beta * gold + predicted), F.lit(0.0))


def exact_counts(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(label, tp, fp, fn): equal spans match one to one, as multisets."""
    key = ["doc_id", "label", "start", "end"]
    g = gold.groupBy(*key).agg(F.count("*").alias("g"))
    p = predicted.groupBy(*key).agg(F.count("*").alias("p"))
    both = g.join(p, key, "full").na.fill(0, ["g", "p"])
    return both.groupBy("label").agg(
        F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("fn")
    )


def precision_recall(counts: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.select(
        "label", "tp", "fp", "fn",
        F.round(F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), 6).alias("precision"),
        F.round(F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)), 6).alias("recall"),
        F.round(F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)), 6).alias("f1"),
    )


def macro_f1(scores: DataFrame) -> DataFrame:
    """The mean F1 of labels that gold has."""
    return scores.where("tp + fn > 0").agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count("*").alias("labels"))


def _fold(gold: list[tuple], predicted: list[tuple], best: bool) -> tuple[int, int, int]:
    """Greedy one-to-one matching in prediction order: the best overlap (later on ties) or the first that is enough."""
    used, tp = set(), 0
    for s, e in predicted:
        choice, most = None, MATCH_IOU
        for i, (gs, ge) in enumerate(gold):
            shared = min(e, ge) - max(s, gs)
            over = shared / ((e - s) + (ge - gs) - shared) if shared > 0 else 0.0
            if i not in used and over >= most:
                choice, most = i, over if best else most
                if not best:
                    break
        if choice is not None:
            used.add(choice)
            tp += 1
    return tp, len(predicted) - tp, len(gold) - tp


def partial_counts(gold: DataFrame, predicted: DataFrame, best: bool = True, order: str | None = None) -> DataFrame:
    """(label, tp, fp, fn) by overlap: a fold over each document's spans of a label.

    Both sides are taken by place, unless they have a column ``order`` that says in which order they were given: which
    span takes which depends on it.
    """
    pair = F.struct("start", "end") if order is None else F.struct(order, "start", "end")
    g = gold.groupBy("doc_id", "label").agg(F.array_sort(F.collect_list(pair)).alias("g"))
    p = predicted.groupBy("doc_id", "label").agg(F.array_sort(F.collect_list(pair)).alias("p"))

    @F.pandas_udf("tp int, fp int, fn int")
    def count(golds: pd.Series, preds: pd.Series) -> pd.DataFrame:
        pairs = lambda x: [] if x is None else [(int(s["start"]), int(s["end"])) for s in x]
        return pd.DataFrame([_fold(pairs(a), pairs(b), best) for a, b in zip(golds, preds)], columns=["tp", "fp", "fn"])

    return g.join(p, ["doc_id", "label"], "full").select("label", count("g", "p").alias("c")).groupBy("label").agg(*[F.sum(f"c.{x}").alias(x) for x in ("tp", "fp", "fn")])


def char_counts(gold: DataFrame, predicted: DataFrame, keys: tuple[str, ...] = ("doc_id",), ignore: DataFrame | None = None) -> DataFrame:
    """Per document the characters of gold, of predictions and of both: interval sums, no row per character.

    Predicted characters in a range of ``ignore`` (keys, start, end) that aren't gold count nowhere.
    """
    g, p = covered(gold, keys), covered(predicted, keys)
    size = F.sum(F.col("end") - F.col("start"))
    hit = shared_chars(g, p, keys).withColumnRenamed("chars", "hit_chars")
    both = g.groupBy(*keys).agg(size.alias("gold_chars")).join(p.groupBy(*keys).agg(size.alias("pred_chars")), list(keys), "full")
    counts = both.join(hit, list(keys), "left").na.fill(0, ["gold_chars", "pred_chars", "hit_chars"])
    if ignore is None:
        return counts
    # What predictions share with gold or ignored ranges, less what they share with gold.
    ranges = (*keys, "start", "end")
    either = covered(gold.select(*ranges).unionByName(ignore.select(*ranges)), keys)
    spared = shared_chars(p, either, keys).withColumnRenamed("chars", "_either")
    left = F.col("pred_chars") - F.coalesce(F.col("_either") - F.col("hit_chars"), F.lit(0))
    return counts.join(spared, list(keys), "left").withColumn("pred_chars", left).drop("_either")


def label_recall(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(label, gold_chars, hit_chars, recall): the share of a label's characters that predictions of any label cover."""
    g = covered(gold, ("doc_id", "label"))
    p = covered(predicted).select("doc_id", F.col("start").alias("_start"), F.col("end").alias("_end"))
    rows = g.join(p, "doc_id").where((F.col("start") < F.col("_end")) & (F.col("_start") < F.col("end")))
    hit = rows.groupBy("label").agg(F.sum(F.least("end", "_end") - F.greatest("start", "_start")).alias("hit_chars"))
    sizes = g.groupBy("label").agg(F.sum(F.col("end") - F.col("start")).alias("gold_chars"))
    both = sizes.join(hit, "label", "left").na.fill(0, ["hit_chars"])
    return both.select("label", "gold_chars", "hit_chars", F.round(F.col("hit_chars") / F.col("gold_chars"), 6).alias("recall"))


def char_scores(counts: DataFrame, by: str) -> DataFrame:
    sums = counts.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("gold_chars", "pred_chars", "hit_chars")])
    cells = {f"f{n}": F.round(f_beta(F.col("hit_chars"), F.col("gold_chars"), F.col("pred_chars"), b), 6) for n, b in (("2", 2.0), ("1", 1.0), ("05", 0.5))}
    return sums.select(by, "gold_chars", "pred_chars", "hit_chars", *[c.alias(n) for n, c in cells.items()])


def leave_one_out(scores: DataFrame, value: str) -> DataFrame:
    """The mean over datasets, and the least and largest mean with one of them left out."""
    everything = W.partitionBy()
    n, total = F.count("*").over(everything), F.sum(value).over(everything)
    rows = scores.select(F.col(value), n.alias("n"), F.when(n > 1, (total - F.col(value)) / (n - 1)).alias("without"))
    return rows.agg(F.round(F.avg(value), 6).alias("macro"), F.round(F.min("without"), 6).alias("least"), F.round(F.max("without"), 6).alias("most"))


def item_cover(items: DataFrame, predicted: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds to items (doc_id, item, class, start, end) how many letters and digits they have and how many of them are masked."""
    c = covered(predicted).select(F.col("doc_id").alias("_id"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    on = (F.col("doc_id") == F.col("_id")) & (F.col("_s") < F.col("end")) & (F.col("start") < F.col("_e"))
    rows = items.join(texts.select("doc_id", "text"), "doc_id").join(c, on, "left")
    plain = lambda cell: F.length(F.regexp_replace(cell, r"[^\p{L}\p{N}]", ""))
    # An item that no span touches has none: greatest and least would skip the nulls.
    part = F.expr("CASE WHEN _s IS NOT NULL THEN substring(text, greatest(start, _s) + 1, least(end, _e) - greatest(start, _s)) END")
    return rows.groupBy(*items.columns).agg(
        F.first(plain(F.expr("substring(text, start + 1, end - start)"))).alias("chars"), F.coalesce(F.sum(plain(part)), F.lit(0)).alias("masked_chars")
    )


def leak_keep(cover: DataFrame, by: str | None = None) -> DataFrame:
    """Shares: must-mask items with a readable letter or digit leak; must-keep items with none masked are kept."""
    must, keep = F.col("class") == "MUST_MASK", F.col("class") == "MUST_KEEP"
    leak, kept = must & (F.col("masked_chars") < F.col("chars")), keep & (F.col("masked_chars") == 0)
    rows = cover.groupBy(by) if by else cover.groupBy()
    out = rows.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("must_mask", must), ("leaked", leak), ("must_keep", keep), ("kept", kept))])
    share = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 6)
    return out.withColumn("leak_rate", share("leaked", "must_mask")).withColumn("keep_rate", share("kept", "must_keep"))


def segments(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Elementary segments (doc_id, start, end) between neighbouring boundaries of any span."""
    points = gold.select("doc_id", F.explode(F.array("start", "end")).alias("start")).unionByName(predicted.select("doc_id", F.explode(F.array("start", "end")).alias("start")))
    w = W.partitionBy("doc_id").orderBy("start")
    return points.distinct().withColumn("end", F.lead("start").over(w)).where("end IS NOT NULL")


def sweep(gold: DataFrame, predicted: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, gold_chars, masked_chars, hit_chars): what each cut would mask, from one pass over elementary segments."""
    seg = segments(gold, predicted)
    holds = lambda s, n: s.select(F.col("doc_id").alias(f"{n}i"), F.col("start").alias(f"{n}s"), F.col("end").alias(f"{n}e"), *([F.col("score")] if n == "p" else []))
    inside = lambda n: (F.col("doc_id") == F.col(f"{n}i")) & (F.col(f"{n}s") <= F.col("start")) & (F.col(f"{n}e") >= F.col("end"))
    scored = seg.join(holds(predicted, "p"), inside("p"), "left").groupBy("doc_id", "start", "end").agg(F.max("score").alias("score"))
    marked = scored.join(holds(gold, "g"), inside("g"), "left").groupBy("doc_id", "start", "end", "score").agg(F.max("gs").isNotNull().alias("gold"))
    size = F.col("end") - F.col("start")
    # One small row per distinct score; only these meet the grid.
    tally = marked.groupBy("score").agg(F.sum(size).alias("chars"), F.sum(F.when(F.col("gold"), size).otherwise(0)).alias("gold"))
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    cut = F.col("score") >= F.col("threshold")
    return tally.select("*", grid).groupBy("threshold").agg(
        F.sum("gold").alias("gold_chars"), F.sum(F.when(cut, F.col("chars")).otherwise(0)).alias("masked_chars"), F.sum(F.when(cut, F.col("gold")).otherwise(0)).alias("hit_chars")
    )


def descend(sweeps: DataFrame, labels: list[str], grid: list[float], over_cap: float, start: float = 0.5) -> dict[str, float]:
    """Cuts by label, chosen greedily: for each label the one with most hits whose over-masking stays under the cap.

    ``sweeps``: label, threshold, gold_chars, masked_chars, hit_chars; one row per label and threshold.
    """
    table = {(r["label"], r["threshold"]): r for r in sweeps.collect()}
    cuts = {}
    for label in labels:
        rows = [(t, table[label, t]) for t in grid if (label, t) in table]
        fits = [(r["hit_chars"], -t) for t, r in rows if r["masked_chars"] - r["hit_chars"] <= over_cap * max(1, r["gold_chars"])]
        cuts[label] = -max(fits)[1] if fits else start
    return cuts


def _resampled(counts: DataFrame, resamples: int, seed: int, beta: float, unit: str) -> DataFrame:
    """(r, f): F-beta of each resample, drawn by Poisson weights of the units."""
    cells = ("hit_chars", "gold_chars", "pred_chars")
    if unit != "doc_id":
        counts = counts.groupBy(unit).agg(*[F.sum(c).alias(c) for c in cells])
    steps = np.cumsum([np.exp(-1) / float(np.prod(range(1, k + 1)) if k else 1) for k in range(8)]).tolist()
    draw = F.pmod(F.xxhash64(unit, "r", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    weight = F.lit(0)
    for s in steps:
        weight = weight + (draw >= s).cast("int")
    rows = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r")).withColumn("w", weight)
    sums = rows.groupBy("r").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in cells])
    return sums.select("r", f_beta(F.col("hit_chars"), F.col("gold_chars"), F.col("pred_chars"), beta).alias("f"))


def _interval(value: str) -> list[Column]:
    return [F.round(F.percentile(value, F.lit(0.025)), 6).alias("low"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, F.lit(0.975)), 6).alias("high")]


def bootstrap(counts: DataFrame, resamples: int = 1000, seed: int = 0, beta: float = 2.0, unit: str = "doc_id") -> DataFrame:
    """A percentile interval of F-beta by Poisson resampling of documents: counts (doc_id, gold_chars, pred_chars, hit_chars).

    A document's weight in a resample depends on its id, the resample and the seed alone, so every tool scored with
    the same seed sees the same resamples, and the sums are plain distributed aggregates. ``unit`` names a column whose
    groups of documents (of one template or source) are drawn as a whole.
    """
    return _resampled(counts, resamples, seed, beta, unit).agg(*_interval("f"))


def paired_difference(a: DataFrame, b: DataFrame, resamples: int = 1000, seed: int = 0, beta: float = 2.0, unit: str = "doc_id") -> DataFrame:
    """(low, mean, high, a_better): the interval of F-beta of ``a`` less that of ``b`` over the same resamples, and the
    share of them in which ``a`` is strictly better. Both hold counts of the same documents."""
    one, two = (_resampled(x, resamples, seed, beta, unit) for x in (a, b))
    rows = one.join(two.withColumnRenamed("f", "g"), "r").withColumn("d", F.col("f") - F.col("g"))
    return rows.agg(*_interval("d"), F.round(F.avg((F.col("d") > 0).cast("double")), 6).alias("a_better"))


def failures(gold: DataFrame, predicted: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent surface forms (kind, label, value, n, rank) of missed and of wrong spans, ties by form."""
    key = ["doc_id", "label", "start", "end"]
    # Both sides meet once, each read once. A null in a key equals nothing.
    sides = [x.select(*key, "value", F.lit(kind).alias("kind")) for x, kind in ((gold, "missed"), (predicted, "wrong"))]
    rows = sides[0].unionByName(sides[1]).groupBy(*key, "value", "kind").agg(F.count("*").alias("n"))
    w = W.partitionBy(*key)
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    rows = rows.withColumn("_both", whole & (F.min("kind").over(w) != F.max("kind").over(w)))
    counts = rows.where(~F.col("_both")).groupBy("kind", "label", "value").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("kind").orderBy(F.col("n").desc(), "label", "value")))
    return ranked.where(F.col("rank") <= top)


def plant(docs: DataFrame, values: list[tuple[str, Column]], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts with labelled values put in after the first space (at the end without one), and their exact gold spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    at = F.when(F.instr(text, " ") > 0, F.instr(text, " ")).otherwise(F.length(text))
    put = F.concat_ws(" ", *[v for _, v in values])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.concat(F.substring(text, F.lit(1), at), put, F.lit(" "), F.substr(text, at + 1)).alias("text"))
    rows, before = [], at
    for label, value in values:
        rows.append(F.struct(F.lit(label).alias("label"), before.alias("start"), (before + F.length(value)).alias("end"), value.alias("value")))
        before = before + F.length(value) + 1
    gold = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(*rows)).alias("g")).select("doc_id", "g.*")
    return texts, gold


def better_rows(scores: DataFrame) -> DataFrame:
    """Per tool its better configuration, and whether the interval of its difference leaves out zero."""
    best = scores.groupBy("tool").agg(F.max_by(F.struct("config", "value", "low", "high"), F.struct("value", "config")).alias("b")).select("tool", "b.*")
    return best.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def decode_logits(rows: DataFrame, array: str, width: int, classes: int, cut: float) -> DataFrame:
    """(id columns, word, span, class, score) of logits [words, width, classes] whose sigmoid reaches the cut."""
    keep = [c for c in rows.columns if c != array]
    cells = rows.select(*keep, F.posexplode(array).alias("i", "x")).withColumn("score", F.round(1 / (1 + F.exp(-F.col("x").cast("double"))), 6))
    return cells.where(F.col("score") >= cut).select(
        *keep, F.floor(F.col("i") / (width * classes)).cast("int").alias("word"), (F.floor(F.col("i") / classes) % width).cast("int").alias("span"), (F.col("i") % classes).cast("int").alias("class"), "score"
    )




def kind_split(cover: DataFrame, kind: str) -> DataFrame:
    """Leak and keep shares of items of one kind and of all others; ``cover`` has a ``kind`` column."""
    return leak_keep(cover.withColumn("of_kind", F.coalesce(F.col("kind") == kind, F.lit(False))), "of_kind")


def coverage_split(items: DataFrame, by_patterns: DataFrame, cover: DataFrame) -> DataFrame:
    """Leak shares of items that the patterns alone mask whole, and of the rest. Re-specified from prose."""
    known = by_patterns.where(F.col("masked_chars") >= F.col("chars")).select("doc_id", "item").withColumn("_k", F.lit(True))
    marked = cover.join(items.select("doc_id", "item"), ["doc_id", "item"], "left_semi").join(known, ["doc_id", "item"], "left")
    return leak_keep(marked.withColumn("by_patterns", F.coalesce("_k", F.lit(False))), "by_patterns")


def task_scores(counts: DataFrame, by: str = "task") -> DataFrame:
    """Per task precision, recall, F2 and the share of other characters that are masked: counts with ``n_chars``."""
    sums = counts.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("gold_chars", "pred_chars", "hit_chars", "n_chars")])
    hit, gold, pred = (F.col(c) for c in ("hit_chars", "gold_chars", "pred_chars"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return sums.select(
        by, share(hit, pred).alias("precision"), share(hit, gold).alias("recall"), F.round(f_beta(hit, gold, pred, 2.0), 6).alias("f2"),
        share(pred - hit, F.col("n_chars") - gold).alias("false_rate"),
    )


def places(scores: DataFrame, value: str = "value") -> DataFrame:
    """Per tool its mean over tasks and its place; equal means share a place."""
    means = scores.groupBy("tool").agg(F.round(F.avg(value), 6).alias("mean"))
    return means.withColumn("place", F.rank().over(W.orderBy(F.col("mean").desc())))


def latency(rows: DataFrame) -> DataFrame:
    """Per (tool, size) the median of the rounds' medians and the 95th percentile of all calls: rows (tool, size, round, ms)."""
    rounds = rows.groupBy("tool", "size", "round").agg(F.percentile("ms", F.lit(0.5)).alias("m")).groupBy("tool", "size").agg(F.percentile("m", F.lit(0.5)).alias("median_ms"))
    return rounds.join(rows.groupBy("tool", "size").agg(F.percentile("ms", F.lit(0.95)).alias("p95_ms")), ["tool", "size"])


def hunks_consistent(text: str) -> bool:
    """Whether each hunk of a unified diff has as many lines as its header says."""
    head = re.compile(r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")
    left = None
    for line in text.split("\n"):
        if match := head.match(line):
            if left and any(left):
                return False
            left = [int(match[1] or 1), int(match[2] or 1)]
        elif left and any(left):
            if line[:1] in ("-", " ", ""):
                left[0] -= 1
            if line[:1] in ("+", " ", ""):
                left[1] -= 1
            if min(left) < 0 or line[:1] not in ("-", "+", " ", "", "\\"):
                return False
    return not left or not any(left)


def summary(cover: DataFrame, texts: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: leak and keep shares, documents with a leak, clean documents masked, characters masked outside items per 1,000."""
    shares = leak_keep(cover)
    leaks = cover.where((F.col("class") == "MUST_MASK") & (F.col("masked_chars") < F.col("chars"))).agg(F.countDistinct("doc_id").alias("leaking_docs"))
    clean = texts.join(cover.where(F.col("class") == "MUST_MASK").select("doc_id"), "doc_id", "left_anti").select("doc_id")
    masked_clean = clean.join(predicted.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.count("*").alias("clean_docs_masked"))
    inside = shared_chars(covered(cover.select("doc_id", "start", "end")), covered(predicted)).agg(F.coalesce(F.sum("chars"), F.lit(0)).alias("inside"))
    everything = covered(predicted).agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("masked"))
    size = texts.agg(F.sum(F.length("text")).alias("n_chars"), F.count("*").alias("docs"))
    row = shares
    for part in (leaks, masked_clean, clean.agg(F.count("*").alias("clean_docs")), inside, everything, size):
        row = row.crossJoin(part)  # one row each
    return row.withColumn("outside_per_1000", F.round(F.try_divide(1000 * (F.col("masked") - F.col("inside")), F.col("n_chars")), 6)).drop("inside")
