"""Language identification with interpolated Kneser-Ney character models.

For each language a model of runs of letters (lower-cased, with marks for start and end) is fitted on a bounded sample of
labelled documents. All models share one sorted array of n-gram hashes with a column for each language, and one of context
hashes. A text goes to the language of the lowest cross-entropy for each symbol. It is rejected if that is further above
what the language's own held-back documents show than their spread and the text's length explain, or if it has no letter.
A model sees no context across words, so each distinct word is scored once and its scores are summed by document.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, small
from .text import buffers, mix, pieces, words

ORDER = 4
#: Documented bounds of what a model is fitted on: documents (as expected) and characters for each language.
SAMPLE_DOCS = 800
SAMPLE_CHARS = 1_500_000
#: Characters of all languages together (each has LEAST_CHARS at least), of one text, and bytes of all models.
ALL_CHARS, LEAST_CHARS = 16_000_000, 10_000
TEXT_CHARS = 40_000
MODEL_BYTES = 400_000_000
#: Values that a task lays out as a matrix; tables of more keys times languages are looked up as they are.
MATRIX_CELLS = 16_000_000
#: Symbols that a model spreads its last share of probability over.
SYMBOLS = 1024
#: Rejection: standard errors for the text's length, spreads between documents, and nats for each symbol.
Z_LENGTH, Z_DOCS, SLACK = 6.0, 6.0, 1.0
CACHE_WORDS = 400_000
UND = "und"
U = np.uint64
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_START, _END = U(1), U(2)


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all letter runs, each after ORDER - 1 start marks and before an end mark; each text's runs' lengths
    as the position where it begins; and which positions are predicted."""
    pad, runs, begin, at = "\x01" * (ORDER - 1), [], [], 0
    for t in texts:
        begin.append(at)
        for r in _LETTERS.findall(t.lower()):
            runs.append(pad)
            runs.append(r)
            runs.append("\x02")
            at += len(r) + ORDER
    code = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return code, np.array([*begin, at], np.int64), code != _START


def _grams(code: np.ndarray, m: int) -> np.ndarray:
    """Hash of the m symbols that end at each position (nonsense before position m - 1)."""
    h = np.full(len(code), mix(np.array([m], U) * U(0x9E3779B97F4A7C15))[0])
    for j in range(m - 1, -1, -1):
        shifted = code if j == 0 else np.concatenate([np.zeros(j, U), code[:-j]])
        h = mix(h * U(0x100000001B3) ^ shifted)
    return h


def _contexts(code: np.ndarray, m: int) -> np.ndarray:
    """Hash of the m - 1 symbols before each position."""
    before = np.concatenate([np.zeros(1, U), code[:-1]]) if len(code) else code
    return _grams(before, m - 1) ^ U(0x5851F42D4C957F2D) if m > 1 else np.full(len(code), U(0x14057B7EF767814F))


def fit(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted n-gram hashes with their discounted probabilities, and sorted context hashes with what they leave to shorter
    contexts. The longest n-grams are counted as they occur, shorter ones by the distinct symbols before them."""
    code, _, predicted = _symbols(texts)
    keys, alphas, ctx_keys, gammas = [], [], [], []
    at = np.flatnonzero(predicted)
    for m in range(ORDER, 0, -1):
        gram, ctx = _grams(code, m)[at], _contexts(code, m)[at]
        if m < ORDER:
            longer = _grams(code, m + 1)[at]
            one = np.unique(longer, return_index=True)[1]
            gram, ctx = gram[one], ctx[one]
        g, first, count = np.unique(gram, return_index=True, return_counts=True)
        c = ctx[first]
        n1, n2 = (count == 1).sum(), (count == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        cs, inv = np.unique(c, return_inverse=True)
        total = np.bincount(inv, count, len(cs))
        left = np.bincount(inv, np.minimum(count, d), len(cs))
        keys.append(g)
        alphas.append(np.maximum(count - d, 0) / total[inv])
        ctx_keys.append(cs)
        gammas.append(left / total)
    k, a, ck, g = (np.concatenate(x) for x in (keys, alphas, ctx_keys, gammas))
    o, p = np.argsort(k), np.argsort(ck)
    return k[o], a[o].astype(np.float32), ck[p], g[p].astype(np.float32)


@dataclass
class Table:
    """Values by (key, language): each key's languages and values stand together, keys ascend."""

    keys: np.ndarray
    start: np.ndarray  # where each key's values begin, and the end
    lang: np.ndarray
    value: np.ndarray
    matrix: np.ndarray | None = None  # made where it is used, never sent

    def __getstate__(self) -> dict:
        return self.__dict__ | {"matrix": None}

    @staticmethod
    def of(parts: list[tuple[np.ndarray, np.ndarray]]) -> Table:
        """From each language's keys and values."""
        key, value = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        lang = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[0]) for p in parts])
        order = np.argsort(key, kind="stable")
        keys, start = np.unique(key[order], return_index=True)
        return Table(keys, np.append(start, len(key)), lang[order], value[order])

    def look(self, wanted: np.ndarray, langs: int, missing: float) -> np.ndarray:
        """A row of all languages' values for each key that is wanted; missing is the same in all calls of a table."""
        if self.matrix is None and 0 < len(self.keys) * langs <= MATRIX_CELLS:
            self.matrix = np.full((len(self.keys), langs), missing, np.float32)
            self.matrix[np.repeat(np.arange(len(self.keys)), np.diff(self.start)), self.lang] = self.value
        if self.matrix is not None:
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            return np.where((self.keys[at] == wanted)[:, None], self.matrix[at], np.float32(missing))
        out = np.full((len(wanted), langs), missing, np.float32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            row = np.flatnonzero(self.keys[at] == wanted)
            n = self.start[at[row] + 1] - self.start[at[row]]
            where = np.repeat(self.start[at[row]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out[np.repeat(row, n), self.lang[where]] = self.value[where]
        return out


@dataclass
class Models:
    langs: list[str]
    alpha: Table  # of n-grams
    gamma: Table  # of contexts
    mean: np.ndarray  # cross-entropy of own documents, its spread by symbol and by document
    by_symbol: np.ndarray
    by_doc: np.ndarray

    def log_probs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """-log p of every predicted symbol under each language, and the text that it belongs to."""
        code, begin, predicted = _symbols(texts)
        at = np.flatnonzero(predicted)
        p = np.full((len(at), len(self.langs)), 1.0 / SYMBOLS, np.float32)
        for m in range(1, ORDER + 1):
            p = self.alpha.look(_grams(code, m)[at], len(self.langs), 0.0) + self.gamma.look(_contexts(code, m)[at], len(self.langs), 1.0) * p
        return -np.log(np.maximum(p, 1e-30)), np.searchsorted(begin, at, "right") - 1

    def totals(self, texts: list[str]) -> np.ndarray:
        """For each text: summed -log p under each language, and the symbols predicted."""
        lp, row = self.log_probs(texts)
        out = np.zeros((len(texts), len(self.langs) + 1))
        for i in range(len(self.langs)):
            out[:, i] = np.bincount(row, lp[:, i], len(texts))
        out[:, -1] = np.bincount(row, minlength=len(texts))
        return out


def merge(models: list[tuple[str, tuple, tuple[float, float, float]]]) -> Models:
    models = sorted(models, key=lambda m: m[0])
    alpha, gamma = (Table.of([(m[1][i], m[1][i + 1]) for m in models]) for i in (0, 2))
    return Models([m[0] for m in models], alpha, gamma, *(np.array([m[2][j] for m in models]) for j in range(3)))


def train(lang: str, texts: list[str]) -> tuple[str, tuple, tuple[float, float, float]] | None:
    """A model of four fifths of the texts, and how it fits the last fifth. Fewer than five texts are cut in five each, so
    that the fit is always measured on what the model hasn't seen; only a text of a few letters serves for both."""
    texts = [t for t in texts if t and _LETTERS.search(t)]
    if not texts:
        return None
    if len(texts) < 5:
        cut = [t[len(t) * i // 5 : len(t) * (i + 1) // 5] for t in texts for i in range(5)]
        texts = [t for t in cut if _LETTERS.search(t)] or texts
    held = texts[::5]
    used = [t for i, t in enumerate(texts) if i % 5] or texts
    model = fit(used)
    lp, row = merge([(lang, model, (0.0, 0.0, 0.0))]).log_probs(held)
    n = np.bincount(row, minlength=len(held))
    by_doc = np.bincount(row, lp[:, 0], len(held)) / np.maximum(n, 1)
    long = by_doc[n >= 200]
    return lang, model, (float(lp.mean()), float(lp.std()), float(long.std()) if len(long) > 1 else 0.1)


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang, text, and chars (how many a language's model takes) of about SAMPLE_DOCS documents of each language, drawn by hash
    from those that may be learned from. Of a text of more than TEXT_CHARS characters go as many, from eight places."""
    may = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2))
    may = may.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    count = may.groupBy("lang").count()
    langs = count.count()
    chars = max(LEAST_CHARS, min(SAMPLE_CHARS, ALL_CHARS // max(langs, 1)))
    part = TEXT_CHARS // 8
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.expr("text").substr((F.floor((F.length("text") - part) * i / 7) + 1).cast("int"), F.lit(part))), " ")
    drawn = may.join(small(count, langs), "lang").withColumn("text", F.when(F.length("text") > TEXT_CHARS, spread).otherwise(F.col("text"))).withColumn("chars", F.lit(chars))
    return drawn.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(float(SAMPLE_DOCS << 20)) / F.col("count")).select("id", "text", "lang", "chars")


def bounded(texts: list[str], most: int = SAMPLE_CHARS, pieces: int = 8) -> list[str]:
    """Texts of `most` characters together: longer ones are cut to one common length, taken from places all over them, so a
    few very long texts don't make up a sample."""
    sizes = np.sort(np.array([len(t) for t in texts], np.int64))
    if sizes.sum() <= most:
        return texts
    left = most - np.concatenate([[0], np.cumsum(sizes)[:-1]])  # what is there for each text and all longer ones
    share = left / (len(sizes) - np.arange(len(sizes)))
    each = max(pieces, int(share[np.argmax(share < sizes)]))
    part = each // pieces
    return [t if len(t) <= each else " ".join(t[(len(t) - part) * i // (pieces - 1) :][:part] for i in range(pieces)) for t in texts]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models | None:
    """Models of all languages of the labelled documents; None if there are none with a letter."""
    ship(docs.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        # The draw's expected size is bounded; the characters that a model takes are bounded here, alike for all its texts.
        order = np.argsort(np.array(table.column("id").to_pylist(), object), kind="stable")
        texts = bounded([table.column("text")[i].as_py() for i in order.tolist()], table.column("chars")[0].as_py())
        got = train(table.column("lang")[0].as_py(), [unicodedata.normalize("NFC", t) for t in texts])
        rows = [] if got is None else [{"lang": got[0], **{f"m{i}": x.tobytes() for i, x in enumerate(got[1])}, "fit": list(got[2])}]
        return pa.Table.from_pylist(rows, pa.schema([("lang", pa.string()), *((f"m{i}", pa.binary()) for i in range(4)), ("fit", pa.list_(pa.float64()))]))

    fitted = cut(labelled_sample(docs, id_col, text_col, lang_col).groupBy("lang").applyInArrow(run, "lang string, m0 binary, m1 binary, m2 binary, m3 binary, fit array<double>"), "models")
    size = fitted.agg(F.sum(F.expr("octet_length(m0) + octet_length(m1) + octet_length(m2) + octet_length(m3)"))).first()[0] or 0
    if size > MODEL_BYTES:
        raise ValueError(f"models of all languages take {size} bytes, more than MODEL_BYTES: too many languages to send to each task")
    rows = fitted.collect()
    kinds = (np.uint64, np.float32, np.uint64, np.float32)
    models = [(r["lang"], tuple(np.frombuffer(r[f"m{i}"], k) for i, k in enumerate(kinds)), tuple(r["fit"])) for r in rows]
    return merge(models) if models else None


class Scorer:
    """Scores texts by their distinct words, of which it remembers a bounded number."""

    def __init__(self, models: Models):
        self.models = models
        self.known = np.zeros(0, U)
        self.scores = np.zeros((0, len(models.langs) + 1), np.float32)
        self.share = 8 / max(8, len(models.langs))  # of many languages, fewer words are scored at once and remembered

    def words(self, keys: np.ndarray, raw) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        found = self.known[at] == keys if len(self.known) else np.zeros(len(keys), bool)
        out = np.zeros((len(keys), self.scores.shape[1]), np.float32)
        out[found] = self.scores[at[found]]
        new = np.flatnonzero(~found)
        step = max(1, int(20_000 * self.share))
        for i in range(0, len(new), step):
            some = new[i : i + step]
            out[some] = self.models.totals([unicodedata.normalize("NFC", raw(j)) for j in some.tolist()])
        if len(new) and len(self.known) < CACHE_WORDS * self.share:
            k = np.concatenate([self.known, keys[new]])
            order = np.argsort(k)
            self.known, self.scores = k[order], np.concatenate([self.scores, out[new]])[order]
        return out

    def texts(self, column: pa.Array) -> np.ndarray:
        data, offs = buffers(column)
        out = [np.zeros((0, self.scores.shape[1]))]
        for i, j in pieces(offs):
            piece = data[offs[i] : offs[j]]
            row, h, start, end = words(piece, offs[i : j + 1] - offs[i])
            keys, first, inv = np.unique(h, return_index=True, return_inverse=True)
            each = self.words(keys, lambda u: piece[start[first[u]] : end[first[u]]].tobytes().decode("utf-8", "replace"))
            sums = np.zeros((j - i, each.shape[1]))
            for c in range(each.shape[1]):
                sums[:, c] = np.bincount(row, each[inv, c], j - i)
            out.append(sums)
        return np.concatenate(out)


def decide(models: Models, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predicted language (or UND), score from 0 to 1, and whether the text is rejected."""
    n = sums[:, -1]
    some = n > 0
    h = sums[:, :-1] / np.maximum(n, 1)[:, None]
    best = np.argmin(h, 1)
    least = h[np.arange(len(h)), best]
    posterior = 1.0 / np.exp(-np.minimum((h - least[:, None]) * n[:, None], 700)).sum(1)
    bound = models.mean[best] + Z_LENGTH * models.by_symbol[best] / np.sqrt(np.maximum(n, 1)) + Z_DOCS * models.by_doc[best] + SLACK
    lang = np.where(some, np.array(models.langs, object)[best], UND)
    return lang, np.where(some, posterior, 0.0), ~some | (least > bound)


def predict(docs: DataFrame, models: Models | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row, from its text alone.

    Null texts and texts without a letter are `und` with score 0 and rejected; so is everything if there is no model. Of
    equal cross-entropies the first language by name wins. Repeated rows are predicted alike; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if models is None:
        return plain.select("doc_id", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    sent = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            lang, score, rejected = decide(sent.value, scorer.texts(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return plain.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected. A null doc_id is neither held out nor learned from."""
    out = predict(docs, learn(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, whose texts aren't rejected; texts stay in their partitions.

    Null texts and texts without a letter go. Where no labelled document has a letter, no language is learned and nothing can
    be said against a text with letters: all these stay. Rows are judged one by one, repeated ones alike; ids may be null."""
    spark = docs.sparkSession
    models = learn(docs, id_col, text_col, lang_col)
    if models is None:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    sent = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            yield b.filter(pa.array(~decide(sent.value, scorer.texts(b.column(text_col)))[2]))

    return docs.mapInArrow(run, docs.schema)
