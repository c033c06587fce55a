"""URL filters: rules, and a character language-model ratio for the rest.

Two smoothed variable-order Markov models of URL bytes are counted over all
URLs that a rule allows and all that a rule blocks.  A URL without a rule is
judged by the difference of its log-likelihoods per byte, against a threshold
calibrated on rule-judged URLs left out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.arrow import texts, with_columns

# Fixed values of the contract: rule, verdict.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of context, and slots of one table of counts; contexts that share a slot share their counts.
ORDER, BITS = 4, 20
#: Weight of the shorter context in a mixture.
WEIGHT = 4.0
#: One in so many rule-judged URLs calibrates and is not counted.
CALIBRATE = 5
#: Steps of the calibration in log-likelihood a byte, and its range.
STEP, RANGE = 0.001, 20.0
END = 255


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.lit(2**31 - 1))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.lit(2**31 - 1))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits host (or a parent domain) and path; null if none does."""
    out = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: len(r[0])):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        out = F.when(fits, text).otherwise(out)
    return out


def slots(urls: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all bytes of all URLs, an end byte included: slots of contexts and of contexts with the byte; URL of each."""
    data = [b"\0" * ORDER + u.encode("utf-8", "replace") + bytes([END]) for u in urls]
    flat = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, data), np.int64, len(data))
    of = np.repeat(np.arange(len(data)), size)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) >= ORDER
    at = np.flatnonzero(inside)
    shift = np.uint64(64 - BITS)
    context, joint = [], []
    key = np.zeros(len(at), dtype=np.uint64)
    for k in range(ORDER + 1):
        if k:
            key = key * np.uint64(257) + flat[at - k] + np.uint64(1)
        own = (key + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        context.append((own >> shift).astype(np.int64))
        with_byte = (own ^ (own >> np.uint64(29))) + flat[at] * np.uint64(0xD6E8FEB86659FD93)
        joint.append(((with_byte * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64))
    return np.array(context), np.array(joint), of[at]


def count(labelled: DataFrame, url: str = "url", side: str = "side") -> np.ndarray:
    """Counts (side, contexts or contexts with the byte, slot) over all rows with side 0 or 1.

    Every task adds up its own slots before the shuffle; what reaches the
    driver has at most four entries a slot, whatever the number of rows.
    """
    width = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 * width, dtype=np.int64)
        for batch in batches:
            of_url = np.array(batch.column(side).to_pylist(), dtype=np.int64)
            context, joint, of = slots(texts(batch, url))
            base = of_url[of] * (2 * width)
            for c, j in zip(context, joint, strict=True):
                total += np.bincount(base + c, minlength=4 * width)
                total += np.bincount(base + width + j, minlength=4 * width)
        at = np.flatnonzero(total)
        for a in range(0, len(at), 1 << 16):
            part = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"slot": part, "n": total[part]})

    rows = labelled.select(url, side).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    got = rows.toArrow()
    table = np.zeros(4 * width)
    table[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return table.reshape(2, 2, width)


def ratio(urls: Sequence[str], table: np.ndarray) -> np.ndarray:
    """Log-likelihood difference, allowed less blocked, per byte of each URL."""
    if not urls:
        return np.zeros(0)
    context, joint, of = slots(urls)
    logs = []
    for contexts, joints in table:
        p = np.full(len(of), 1 / 256)
        for c, j in zip(context, joint, strict=True):
            p = (np.minimum(joints[j], contexts[c]) + WEIGHT * p) / (contexts[c] + WEIGHT)
        logs.append(np.log(p))
    size = np.bincount(of, minlength=len(urls))
    return np.bincount(of, logs[0] - logs[1], minlength=len(urls)) / size


def score(rows: DataFrame, table: np.ndarray, url: str = "url", out: str = "score") -> DataFrame:
    """``rows`` with the ratio of every URL; null counts as empty."""
    sent = rows.sparkSession.sparkContext.broadcast(table.astype(np.float32))

    def make():
        counts = sent.value.astype(np.float64)
        return lambda batch: [ratio(texts(batch, url), counts)]

    return with_columns(rows, [(out, "double")], make)


def calibrate(scored: DataFrame, side: str = "side", score: str = "score") -> float:
    """The threshold of the best balanced accuracy, the one nearest to 0 of several; 0 without both sides."""
    most = int(RANGE / STEP)
    step = F.least(F.greatest(F.floor(F.col(score) / STEP), F.lit(-most)), F.lit(most - 1))
    bins = scored.groupBy(step.cast("int").alias("step"), F.col(side).alias("side")).agg(F.count(F.lit(1)).alias("n"))
    n = np.zeros((2, 2 * most))
    for step, s, c in bins.collect():  # at most two rows a step
        n[s, step + most] = c
    if not n[0].sum() or not n[1].sum():
        return 0.0
    below = np.concatenate([[0], np.cumsum(n[1]) / n[1].sum()])  # blocked below the threshold
    kept = 1 - np.concatenate([[0], np.cumsum(n[0]) / n[0].sum()])
    good = below + kept
    best = np.flatnonzero(good >= good.max() - 1e-12)
    # The middle of the run of equal thresholds that is nearest to 0.
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    middle = min((float(r.mean()) - most for r in runs), key=abs)
    return middle * STEP


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Host, path, rule, verdict and score of every row; a null URL has neither host nor path.

    Without URLs of both sides the model allows everything.
    """
    verdict = dict(rules)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    rows = rows.withColumns({"host": host(F.coalesce("url", F.lit(""))), "path": path(F.coalesce("url", F.lit("")))})
    rows = rows.withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    side = F.lit(None).cast("int")
    for text, v in verdict.items():
        side = F.when(F.col("rule") == text, int(v == "block")).otherwise(side)
    rows = rows.withColumn("side", side)
    calibrates = F.pmod(F.crc32("url"), F.lit(CALIBRATE)) == 0
    known = rows.where(F.col("side").isNotNull())
    table = count(known.where(~calibrates))
    threshold = calibrate(score(known.where(calibrates).select("url", "side"), table))
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return score(rows, table).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.when(F.col("side") == 0, "allow").when(F.col("side") == 1, "block").otherwise(by_model).alias("verdict"),
        "score",
    )
