"""Groups of spelling variants: words one edit apart, each led to the far more frequent one."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urban_spark.llm.shared import cut, written

#: Distinct words that a task counts before it gives them out, and words whose signatures leave it at once.
DISTINCT, WORDS = 200_000, 4_000
#: Parts of the letters, for words of one length (two letters differ) and for those one letter apart (one does).
PARTS_SAME, PARTS_LONGER = 4, 3


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6, min_count: int = 5, drop_every: int | None = None) -> DataFrame:
    """(word, n): runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of `min_chars` code points that occur `min_count` times.

    With `drop_every` a run loses a code point if that number divides the CRC-32 h of `<id>:<run>`: the one at h modulo its
    length. Null ids are written as nothing there. Null and empty texts have no words; repeated rows count each time.
    """
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{min_chars},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, start = Counter(runs.findall((text or "").encode().lower().decode())), zlib.crc32(f"{'' if name is None else name}:".encode())
                for run, n in own.items():
                    if drop_every and (h := zlib.crc32(run.encode(), start)) % drop_every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < min_chars:
                            continue
                    seen[run] += n
                if len(seen) > DISTINCT:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                    seen = Counter()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _enumerated(letters: list[tuple[str, int]], parts: int, differ: int) -> list[str]:
    """PartEnum of a set: its elements dealt to `parts`, and what lies in each choice of all but `differ` parts. Sets that differ in
    `differ` elements at most agree on one of them."""
    dealt: list[list[str]] = [[] for _ in range(parts)]
    for letter, at in letters:
        dealt[zlib.crc32(f"{letter}{at}".encode()) % parts].append(f"{letter}{at}")
    return [f"{chosen}{[sorted(dealt[p]) for p in chosen]}" for chosen in combinations(range(parts), parts - differ)]


def signatures(word: str) -> Iterator[str]:
    """Signatures of which two words one edit apart share one. Letters with their running numbers are the ones of a binary vector; it
    differs from that of a word with one letter replaced in two places, and from that of a word with one letter more or less in one. An
    edit also leaves the first half of the word alone or the last, so each signature is told apart by either half."""
    seen: Counter = Counter()
    letters = []
    for letter in word:
        seen[letter] += 1
        letters.append((letter, seen[letter]))
    size = len(word)
    for kind, length, parts, differ in (("same", size, PARTS_SAME, 2), ("longer", size, PARTS_LONGER, 1), ("longer", size - 1, PARTS_LONGER, 1)):
        half = length // 2
        for part in _enumerated(letters, parts, differ):
            yield f"{kind} {length} {part} first {word[:half]}"
            yield f"{kind} {length} {part} last {word[size - length + half :]}"


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, n, near_n), both ways: words of `words` (word, n) that one inserted, deleted or replaced code point tells apart."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, WORDS):
                part = batch.slice(at, WORDS)
                keys, own = [], []
                for i, word in enumerate(part.column(0).to_pylist()):
                    found = {xxhash.xxh64_intdigest(s.encode()) - (1 << 63) for s in signatures(word)}
                    keys += found
                    own += [i] * len(found)
                take = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), part.column(0).take(take), part.column(1).take(take)], ["key", "word", "n"])

    rows = words.select("word", "n").mapInArrow(signed, "key long, word string, n long")
    # No side is broadcast: Spark takes the signatures, 24 a word, for as small as the compressed words they are made from.
    a, b = rows.alias("a").hint("merge"), rows.select("key", F.col("word").alias("near"), F.col("n").alias("near_n")).alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("word") < F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
    once = pairs.select("word", "near", "n", "near_n").distinct()
    return once.select(F.explode(F.array(F.struct("word", "near", "n", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("near_n").alias("n"), F.col("n").alias("near_n")))).alias("p")).select("p.*")


def spelling_groups(words: DataFrame, *, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of `words` (word, n), whose words are distinct.

    Words are near if one inserted, deleted or replaced code point tells them apart; n_near counts them. A word's form is the
    most frequent near word (of equal ones the first in code-point order), if it is `ratio` times as frequent; its root is
    where the forms end, the word itself without one.

    Near words are found by an equi-join on signatures of their letters, and each pair of a signature is verified.
    A word that is near a hundred thousand others, such as one that all typos are one edit from, is counted by partial
    aggregation. No words: no rows.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words")
    words = written(words.select("word", "n"), "variant-words")
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    frequent = -F.col("best.less") >= ratio * F.col("n")
    found = cut(
        words.hint("merge").join(best, "word", "left").select(
            "word", F.when(frequent, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, -F.col("best.less")).alias("form_n")
        )
    )
    roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round looks twice as far; counts grow by the ratio at each form, so there are few
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_root"))
        step = cut(roots.hint("merge").join(further, "root", "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return found.hint("merge").join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
