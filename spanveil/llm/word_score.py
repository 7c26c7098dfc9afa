"""Cross-entropy difference of word models: bigrams counted in tables that grow with the corpus."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, shared_dir, written

#: Tokens are lower-case words and single other visible characters; an end mark closes a text. No token looks like a mark.
WORD = re.compile(r"\w+|[^\w\s]")
START, END = "\x00start", "\x00end"
#: Tokens of a block at most, unless one text alone has more; pseudo-counts of the unigram model in every history.
BLOCK, PRIOR = 4 << 20, 32.0


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def _squeeze(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _expand(held: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(held), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _pack(kind: pa.DataType):
    """Documents as blocks: ids, sizes, the hashes of a block's words, and its tokens as places in them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import array

        part, made = TaskContext.get().partitionId(), 0
        ids, sizes, places, tokens = [], [], {END: 0}, array.array("i")

        def block() -> pa.RecordBatch:
            words = np.fromiter((_hash(w) for w in places), np.uint64, len(places))
            cells = [[(part << 24) + made], [ids], [sizes], [words.tobytes()], [_squeeze(np.frombuffer(tokens, np.int32))]]
            types = [pa.int64(), pa.list_(kind), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], ["block", "ids", "sizes", "words", "tokens"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = WORD.findall(text.lower())
                if ids and len(tokens) + len(found) >= BLOCK:
                    yield block()
                    made += 1
                    ids, sizes, places, tokens = [], [], {END: 0}, array.array("i")
                tokens.extend([places.setdefault(w, len(places)) for w in found])
                tokens.append(0)
                ids.append(doc_id)
                sizes.append(len(found) + 1)
        if ids:
            yield block()

    return pack


def _bucketed(blocks: DataFrame) -> DataFrame:
    """Blocks written to the shared folder in buckets by their number: what is joined to them moves, they never do.

    The table's name is dropped once its files are known; the files stay like those of other written tables.
    """
    spark, name = blocks.sparkSession, f"word_blocks_{uuid.uuid4().hex}"
    blocks.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    held = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return held


def _bigrams(words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each token's bigram, and the place of its history; a text's first history is as frequent as the end mark."""
    history = np.concatenate([[0], tokens[:-1]])
    before = words[history]
    before[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = np.uint64(_hash(START))
    keys = (before * np.uint64(0x9E3779B97F4A7C15) + words[tokens]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return keys ^ (keys >> np.uint64(29)), history


def _ordered(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct keys by bucket, then key, and the bounds of the buckets in it."""
    bucket = keys % np.uint64(buckets)
    order = np.lexsort((keys, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


def _requests(buckets: int):
    """Per block and bucket: its distinct words (kind 0) and bigrams (kind 1) with their counts in all texts and in the target's.

    Keys of a bucket leave the same remainder, so their quotients tell them apart.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, tokens, sizes = np.frombuffer(row["words"], np.uint64), _expand(row["tokens"]).astype(np.int64), np.array(row["sizes"])
                chosen = np.zeros(len(sizes), bool)
                chosen[np.array(row["marks"] or [], np.int64)] = True
                wanted = np.repeat(chosen, sizes)
                found, back = np.unique(_bigrams(words, tokens, sizes)[0], return_inverse=True)
                for kind, keys, at in ((0, words, tokens), (1, found, back)):
                    general, target = np.bincount(at, minlength=len(keys)), np.bincount(at[wanted], minlength=len(keys))
                    order, bounds = _ordered(keys, buckets)
                    cells = [
                        (b, row["block"], kind, _squeeze(np.diff(keys[o] // np.uint64(buckets), prepend=np.uint64(0))), _squeeze(general[o]), _squeeze(target[o]))
                        for b in range(buckets) if len(o := order[bounds[b] : bounds[b + 1]])
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3))], ["bucket", "block", "kind", "keys", "n", "t"])

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """Whole counts of a bucket's keys, dealt back to the blocks that asked, and the bucket's distinct words and tokens."""
    out = []
    for kind in (0, 1):
        rows = [r for r in table.to_pylist() if r["kind"] == kind]
        if not rows:
            continue
        parts = [np.cumsum(_expand(r["keys"]), dtype=np.uint64) for r in rows]
        keys, back = np.unique(np.concatenate(parts), return_inverse=True)
        sums = [np.bincount(back, np.concatenate([_expand(r[c]) for r in rows]).astype(float)).astype(np.int64) for c in "nt"]
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        for i, (row, at) in enumerate(zip(rows, np.split(back, cuts))):
            whole = (len(keys), int(sums[0].sum()), int(sums[1].sum())) if not kind and not i else (0, 0, 0)
            out.append((row["block"], row["bucket"], kind, _squeeze(sums[0][at]), _squeeze(sums[1][at]), *whole))
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 3)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["block", "bucket", "kind", "n", "t", "words", "all_n", "all_t"])


def _score(buckets: int, vocabulary: int, totals: tuple[int, int], prior: float, kind: pa.DataType):
    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        ids, done = [], []
        held = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        for row in block.to_pylist():
            words, tokens, sizes = np.frombuffer(row["words"], np.uint64), _expand(row["tokens"]).astype(np.int64), np.array(row["sizes"])
            pairs, history = _bigrams(words, tokens, sizes)
            found, back = np.unique(pairs, return_inverse=True)
            counts = {}
            for which, keys in ((0, words), (1, found)):
                order, _ = _ordered(keys, buckets)
                for c in "nt":
                    counts[which, c] = np.empty(len(keys))
                    counts[which, c][order] = np.concatenate([_expand(r[c]) for r in held if r["kind"] == which])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            means = []
            for c, total in zip("nt", totals):
                one = (counts[0, c][tokens] + 1) / (total + vocabulary)
                two = (counts[1, c][back] + prior * one) / (counts[0, c][history] + prior)
                means.append(np.add.reduceat(-np.log2(two), starts) / sizes)
            ids += row["ids"]
            done.append((sizes, means[1], means[0]))
        n, target, general = (np.concatenate(x) for x in zip(*done))
        return pa.Table.from_arrays(
            [pa.array(ids, kind), pa.array(n.astype(np.int64)), pa.array(target), pa.array(general), pa.array(general - target)],
            ["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
        )

    return score


def word_cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, prior: float = PRIOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, target_loss, background_loss, score (bits per token).

    Word bigram models, smoothed by ``prior`` pseudo-counts of the add-one unigram model over one vocabulary: every
    word of the corpus and the end mark. The background counts every document, the target those whose id is in
    ``target_ids`` (one column). Every n-gram is counted and none cut off: blocks of documents send theirs by hash to
    buckets, whose number grows with the corpus, and get whole counts back; the driver sees only totals. A null text
    is one end mark, a null id isn't in the target, and without target documents the target model is uniform.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    base = id_and_text(docs, id_col, text_col)
    named = base.schema["doc_id"].dataType
    kind, sql = to_arrow_type(named), named.simpleString()
    blocks = _bucketed(base.mapInArrow(_pack(kind), f"block bigint, ids array<{sql}>, sizes array<int>, words binary, tokens binary"))
    tokens = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(64, 2 * -(-tokens // BLOCK))
    wanted = target_ids.toDF("wanted").where("wanted IS NOT NULL").distinct()
    places = blocks.select("block", F.posexplode("ids").alias("at", "doc_id"))
    # A merge join at every size: the ids of the target grow with the corpus.
    marks = places.join(wanted.hint("merge"), F.col("doc_id") == F.col("wanted")).groupBy("block").agg(F.collect_list("at").alias("marks"))
    flagged = blocks.drop("ids").join(marks.hint("merge"), "block", "left").select("block", "sizes", "words", "tokens", "marks")
    requests = flagged.mapInArrow(_requests(buckets), "bucket bigint, block bigint, kind int, keys binary, n binary, t binary")
    answers = written(
        requests.groupBy("bucket").applyInArrow(_answer, "block bigint, bucket bigint, kind int, n binary, t binary, words bigint, all_n bigint, all_t bigint"),
        "counts",
    )
    whole = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "all_n", "all_t")]).first()
    score = _score(buckets, whole[0], (whole[1], whole[2]), prior, kind)
    asked = answers.select("block", "bucket", "kind", "n", "t").groupBy("block")
    return blocks.groupBy("block").cogroup(asked).applyInArrow(score, f"doc_id {sql}, n_tokens bigint, target_loss double, background_loss double, score double")
