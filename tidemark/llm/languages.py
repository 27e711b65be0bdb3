"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text
from .shared import saved

U64 = np.uint64
ORDER, GAP, CHUNK = 4, 0x20, 1 << 21
ROW, REST = "language id: row", "language id: rest"
MASKS = [U64((1 << 16 * k) - 1) for k in range(ORDER + 1)]


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """Code points of the basic plane to lower-case letters; all else is one gap symbol."""
    out = np.full(0x10000, GAP, np.uint16)
    for c in range(0x10000):
        low = chr(c).lower()
        if chr(c).isalpha():
            out[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed 4-grams (16 bits a letter) of all rows, their rows, and which rows have a letter.

    Runs of non-letters are one gap, and a row starts after gaps. Letters beyond the
    basic plane share the private-use values."""
    lengths = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    codes = folded()[np.minimum(points, 0xFFFF)]
    wide = np.flatnonzero(points > 0xFFFF)
    codes[wide] = [0xE000 + int(c) % 6400 if chr(c).isalpha() else GAP for c in points[wide]]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(lengths))
    gap = codes == GAP
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(gap[1:] & gap[:-1] & (row[1:] == row[:-1]))
    keep &= ~(gap & np.isin(np.arange(len(codes)), lengths[:-1]))  # a leading gap is the row's start
    codes, row = codes[keep].astype(U64), row[keep]
    letters = np.bincount(row[codes != GAP], minlength=len(offsets) - 1) > 0
    at = np.arange(len(codes)) - np.searchsorted(row, row)
    out = codes.copy()
    for k in range(1, ORDER):
        before = np.full(len(codes), GAP, U64)
        before[k:] = codes[:-k]
        before[at < k] = GAP
        out |= before << U64(16 * k)
    return out, row, letters


class Level:
    """Known grams of one length: probability; contexts: weight left to the next shorter one."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, lower, symbols: int):
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        self.contexts, at = np.unique(keys >> U64(16), return_inverse=True)  # all but the last symbol
        total, kinds = np.bincount(at, counts), np.bincount(at)
        left = discount * kinds / total
        below = lower(keys) if lower else np.full(len(keys), 1.0 / (symbols + 1))
        p = np.maximum(counts - discount, 0) / total[at] + left[at] * below
        order, other = np.argsort(text.mix(keys)), np.argsort(text.mix(self.contexts))
        self.hashes, self.p = text.mix(keys)[order], p[order]
        self.contexts, self.left = text.mix(self.contexts)[other], left[other]


def lookup(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted hash array, and whether the key is there."""
    keys = text.mix(keys)
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return at, hashes[at] == keys


class KneserNey:
    """One language: raw counts for 4-grams, continuation counts for shorter ones."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels: list[Level] = []
        kinds, self.symbols = [(keys, counts)], len(np.unique(keys & MASKS[1]))
        for length in range(ORDER - 1, 0, -1):
            kinds.append(np.unique(kinds[-1][0] & MASKS[length], return_counts=True))
        for length, (k, n) in enumerate(reversed(kinds), 1):
            lower = (lambda x, m=length - 1: self.probability(x, m)) if length > 1 else None
            self.levels.append(Level(k, n.astype(float), lower, self.symbols))

    def probability(self, keys: np.ndarray, length: int = ORDER) -> np.ndarray:
        p = np.full(len(keys), 1.0 / (self.symbols + 1))
        for k, level in enumerate(self.levels[:length], 1):
            own = keys & MASKS[k]
            at, known = lookup(level.hashes, own)
            place, seen = lookup(level.contexts, own >> U64(16))
            p = np.where(known, level.p[at], np.where(seen, level.left[place], 1.0) * p)
        return p


class Tables:
    """The levels of all languages as tables, for counts that one machine does not hold."""

    def __init__(self, counts: DataFrame, names: list[str]):
        langs = counts.sparkSession.createDataFrame(list(enumerate(names)), "lang int, label string")
        kinds = [saved(counts.join(F.broadcast(langs), "label").select("lang", F.col("gram").alias("key"), "n"))]
        for length in range(ORDER - 1, 0, -1):
            kinds.insert(0, saved(kinds[0].groupBy("lang", self.suffix("key", length).alias("key")).agg(F.count("*").alias("n"))))
        self.languages, self.levels = len(names), []
        self.symbols = saved(kinds[0].groupBy("lang").agg((1.0 / (F.count("*") + 1)).alias("p")))
        for length, kind in enumerate(kinds, 1):
            once, twice = (F.count_if(F.col("n") == k) for k in (1, 2))
            discount = kind.groupBy("lang").agg(F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.5).alias("discount"))
            kind = kind.withColumn("context", F.shiftrightunsigned("key", 16))
            contexts = kind.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(F.broadcast(discount), "lang")
            contexts = saved(contexts.withColumn("left", F.col("discount") * F.col("kinds") / F.col("total")))
            if length == 1:
                below = kind.join(F.broadcast(self.symbols), "lang")
            else:
                lower = self.levels[-1][0].withColumnRenamed("key", "lower")
                below = kind.withColumn("lower", self.suffix("key", length - 1)).join(lower, ["lang", "lower"])
            own = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total") + F.col("left") * F.col("p")
            self.levels.append((saved(below.join(contexts, ["lang", "context"]).select("lang", "key", own.alias("p"))), contexts.select("lang", "context", "left")))

    @staticmethod
    def suffix(key: str, length: int) -> Column:
        return F.col(key).bitwiseAND(F.lit((1 << 16 * length) - 1)) if length < ORDER else F.col(key)

    def probabilities(self, grams: DataFrame) -> DataFrame:
        """Distinct grams with the array p of their probabilities, one for each language."""
        rows = grams.select("gram", F.explode(F.sequence(F.lit(0), F.lit(self.languages - 1))).alias("lang")).join(F.broadcast(self.symbols), "lang")
        for length, (level, contexts) in enumerate(self.levels, 1):
            rows = rows.withColumn("key", self.suffix("gram", length)).withColumn("context", F.shiftrightunsigned("key", 16))
            rows = rows.join(level.withColumnRenamed("p", "known"), ["lang", "key"], "left").join(contexts, ["lang", "context"], "left")
            rows = rows.select("gram", "lang", F.coalesce("known", F.coalesce("left", F.lit(1.0)) * F.col("p")).alias("p"))
        return rows.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("lang", "p")))["p"].alias("p"))


@dataclass
class Model:
    """Languages, their models, a joint table of log probabilities, and the calibration.

    With tables, there are no models here and the table has the most frequent grams only."""

    names: list[str]
    models: list[KneserNey]
    hashes: np.ndarray
    table: np.ndarray
    sharpness: float = 20.0
    least: float = 0.0
    most_entropy: float = np.inf
    tables: Tables | None = None

    def logs(self, keys: np.ndarray) -> np.ndarray:
        if not self.models:  # other grams are added as sums
            at, known = lookup(self.hashes, keys) if len(self.hashes) else (None, np.zeros(len(keys), bool))
            return np.where(known[:, None], self.table[at], 0.0) if len(self.hashes) else np.zeros((len(keys), len(self.names)))
        at, known = lookup(self.hashes, keys)
        out = self.table[at]
        if not known.all():
            new, back = np.unique(keys[~known], return_inverse=True)
            out[~known] = np.stack([np.log(m.probability(new)) for m in self.models], 1)[back]
        return out

    def entropies(self, column, rest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per letter of every row under every language, and which rows have a letter.

        rest: sums of the logs of grams that are not in the table."""
        data, offsets = text.utf8(column)
        parts, found = [np.zeros((0, len(self.names)))], [np.zeros(0, bool)]
        for a, b in text.chunks(offsets, CHUNK):
            keys, row, letters = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            count = np.maximum(np.bincount(row, minlength=b - a), 1)
            logs = self.logs(keys)
            sums = np.stack([np.bincount(row, logs[:, k], minlength=b - a) for k in range(len(self.names))], 1)
            parts.append(-(sums if rest is None else sums + rest[a:b]) / count[:, None])
            found.append(letters)
        return np.concatenate(parts), np.concatenate(found)

    def scores(self, entropy: np.ndarray) -> np.ndarray:
        weight = np.exp(-self.sharpness * (entropy - entropy.min(axis=1, keepdims=True)))
        return weight.max(axis=1) / weight.sum(axis=1)


def count_grams(docs: DataFrame) -> DataFrame:
    """Rows (label, gram, n) over all documents; each task sums up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            labels = np.array(batch["label"].to_pylist(), object)
            data, offsets = text.utf8(batch["text"])
            for a, b in text.chunks(offsets, CHUNK):
                keys, row, _ = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for label in set(labels[a:b]):
                    found = np.unique(keys[(labels[a:b] == label)[row]], return_counts=True)
                    held.setdefault(label, []).append(found)
                    if len(held[label]) >= 8:
                        held[label] = [merge(held[label])]
        for label, parts in held.items():
            keys, n = merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["label", "gram", "n"])

    def merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    return docs.mapInArrow(count, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, label_col: str, text_col: str = "text", calibrate: Column | None = None, most_grams: int = 4_000_000, sample: int = 4000, id_col: str = "doc_id") -> Model | None:
    """Models for all labels, from all rows with a label and a text; None without such rows.

    calibrate: which rows to draw about `sample` from at most, to calibrate on; all others
    are counted. A label whose rows are all marked is counted only. Rows are drawn one by one by id_col,
    text and their number in a saved copy of the marked rows, also where whole rows repeat. Up to most_grams (label, 4-gram) rows, and four
    times as many probabilities, the models are arrays that every task holds; beyond that
    they are tables, all counts included, and only the most frequent grams are held."""
    rows = docs.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), F.coalesce(F.lit(False) if calibrate is None else calibrate, F.lit(False)).alias("held"), F.xxhash64(*([id_col] if id_col in docs.columns else []), text_col).alias("hash")).where("label is not null and text is not null")
    counted = rows.select("label", "text")
    if calibrate is not None:
        sizes = rows.groupBy("label").agg(F.count("*"), F.count_if("held")).collect()  # a row per label
        share = min(1.0, sample / max(1, sum(r[2] for r in sizes)))
        may = F.col("held") & ~F.col("label").isin([r[0] for r in sizes if r[1] == r[2]])
        number = F.xxhash64("hash", F.monotonically_increasing_id())  # saved, so that every job draws the same rows
        some = saved(rows.where(may).select("label", "text", (F.pmod(number, F.lit(1 << 20)) < int(share * (1 << 20))).alias("drawn")))
        counted = rows.where(~may).select("label", "text").unionByName(some.where("not drawn").select("label", "text"))
    counts = count_grams(counted).persist()
    try:
        size, kinds, names = counts.count(), counts.select("gram").distinct().count(), sorted(r[0] for r in counts.select("label").distinct().collect())
        if not names:
            return None
        if size > most_grams or kinds * len(names) > 4 * most_grams:
            model = wide(counts, names, 4 * most_grams // len(names))
        else:
            table = counts.orderBy("label", "gram").toArrow()
            labels = np.array(table["label"].to_pylist(), object)
            keys, n = table["gram"].to_numpy().view(U64), table["n"].to_numpy()
            models = [KneserNey(keys[labels == x], n[labels == x]) for x in names]
            union = np.unique(keys)
            union = union[np.argsort(text.mix(union))]
            model = Model(names, models, text.mix(union), np.stack([np.log(m.probability(union)) for m in models], 1))
    finally:
        counts.unpersist()
    if calibrate is not None:
        fit(model, some.where("drawn").select("label", "text"))
    return model


def wide(counts: DataFrame, names: list[str], most: int) -> Model:
    """A model in tables, of which the `most` most frequent grams at most are held as well."""
    tables = Tables(counts, names)
    totals = saved(counts.groupBy("gram").agg(F.floor(F.log2(F.sum("n"))).alias("size")))
    least = 64
    for size, n in sorted(((r[0], r[1]) for r in totals.groupBy("size").count().collect()), reverse=True):  # 64 rows at most
        most -= n
        if most < 0:
            break
        least = size
    held = tables.probabilities(totals.where(F.col("size") >= least).select("gram")).toArrow()
    hashes = text.mix(held["gram"].to_numpy().view(U64))
    order = np.argsort(hashes)
    return Model(names, [], hashes[order], stacked(held["p"].combine_chunks(), len(names), np.log)[order], tables=tables)


def stacked(column, width: int, change=lambda x: x) -> np.ndarray:
    """A column of arrays of the same length as a matrix."""
    return change(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)


def with_rest(docs: DataFrame, held, model: Model, text_col: str) -> DataFrame:
    """docs with the sums of the logs of all grams that are not held, found by joins."""
    rows = saved(docs.withColumn(ROW, F.monotonically_increasing_id()))  # saved, so that numbers are the same in every job

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = held.value.hashes
        for batch in batches:
            data, offsets = text.utf8(batch["text"])
            for a, b in text.chunks(offsets, CHUNK):
                keys, row, _ = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if len(hashes):
                    new = ~lookup(hashes, keys)[1]
                    keys, row = keys[new], row[new]
                order = np.lexsort((keys, row))
                keys, row = keys[order], row[order]
                heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])]))
                n = np.diff(np.append(heads, len(keys)))
                yield pa.RecordBatch.from_arrays([batch["row"].take(pa.array(row[heads] + a)), pa.array(keys[heads].view(np.int64)), pa.array(n, pa.int64())], ["row", "gram", "n"])

    asked = saved(rows.select(F.col(ROW).alias("row"), F.col(text_col).alias("text")).mapInArrow(others, "row long, gram long, n long"))
    found = saved(model.tables.probabilities(asked.select("gram").distinct()))
    width = len(model.names)
    sums = asked.join(found, "gram").groupBy("row").agg(F.array(*(F.sum(F.col("n") * F.log(F.col("p")[k])) for k in range(width))).alias(REST))
    rows = rows.join(sums.withColumnRenamed("row", ROW), ROW, "left")
    return rows.select(*docs.columns, F.coalesce(REST, F.array(*(F.lit(0.0) for _ in range(width)))).alias(REST))


def with_entropies(docs: DataFrame, model: Model, text_col: str, finish, schema) -> DataFrame:
    """What finish makes of every batch of docs: of the model, the columns, the entropies, and which rows have a letter."""
    held = docs.sparkSession.sparkContext.broadcast(replace(model, tables=None))
    where, width = docs.columns.index(text_col), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            rest = stacked(batch.column(width), len(model.names)) if batch.num_columns > width else None
            yield finish(model, batch.columns[:width], *model.entropies(batch.column(where), rest))

    return (docs if model.tables is None else with_rest(docs, held, model, text_col)).mapInArrow(run, schema)


def fit(model: Model, drawn: DataFrame) -> None:
    """Sharpness by likelihood on the drawn rows; bounds that reject half a percent of the right ones each."""

    def finish(model: Model, columns: list, entropy: np.ndarray, letters: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[0], pa.array(list(entropy), pa.list_(pa.float64())), pa.array(letters)], ["label", "entropy", "letters"])

    drawn = with_entropies(drawn, model, "text", finish, "label string, entropy array<double>, letters boolean").toArrow()
    entropy, letters = stacked(drawn["entropy"].combine_chunks(), len(model.names)), np.array(drawn["letters"].to_pylist(), bool)
    right = np.array([model.names.index(x) if x in model.names else -1 for x in drawn["label"].to_pylist()], np.int64)
    entropy, right = entropy[letters & (right >= 0)], right[letters & (right >= 0)]
    if not len(right):
        return
    gap = entropy - entropy.min(axis=1, keepdims=True)
    loss = lambda s: (s * gap[np.arange(len(right)), right] + np.log(np.exp(-s * gap).sum(axis=1))).mean()
    model.sharpness = float(min(np.geomspace(0.5, 200, 60), key=loss))
    good = entropy.argmin(axis=1) == right
    if good.any():
        model.least = float(np.quantile(model.scores(entropy)[good], 0.005))
        model.most_entropy = float(np.quantile(entropy.min(axis=1)[good], 0.995))


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", reject: bool = False) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and rejected; a clash of names is replaced.

    The language of the lowest cross-entropy per letter wins, a tie goes to the first
    name. Null texts, texts without a letter, and all if there is no model: `und`, score
    0, rejected. rejected marks guesses below the calibrated bounds; with reject they
    become `und` too. Whole texts are read; one pass, no shuffle, unless the model is in
    tables: then grams that are not held are summed up by document and joined to them."""
    docs = docs.drop("lang_pred", "score", "rejected")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True)})
    columns = docs.columns
    schema = T.StructType(list(docs.schema)).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def finish(model: Model, found: list, entropy: np.ndarray, letters: np.ndarray) -> pa.RecordBatch:
        score = np.where(letters, model.scores(entropy), 0.0)
        poor = ~letters | (score < model.least) | (entropy.min(axis=1) > model.most_entropy)
        best = np.where(poor if reject else ~letters, len(model.names), entropy.argmin(axis=1))
        names = pa.array([*model.names, "und"], pa.string()).take(pa.array(best))
        return pa.RecordBatch.from_arrays([*found, names, pa.array(score), pa.array(poor)], names=[*columns, "lang_pred", "score", "rejected"])

    return with_entropies(docs, model, text_col, finish, schema)
