"""Language identification by hierarchical discrimination.

A text is first given a language family, by one linear support vector machine per family, then a
language of that family, by one-versus-one machines between its languages. Features are hashed
frequencies of byte groups of two, three and four over the whole lower-cased text, where all that
is no letter counts as a blank.

Training reads a bounded, documented sample: at most `per_language` labelled training documents of
each language, those with the smallest hash of doc_id. Each machine is fitted by its own
task (dual coordinate descent). Prediction runs over every document inside the scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import KEY, held_out, key, settle, sliced, texts

PER_LANGUAGE = 400
PARTS = 64
GROUPS = (2, 3, 4)
BITS = 13
SCALE = 40.0
STEEPNESS = 3.0
UNDETERMINED = "und"
#: Prediction takes about 30 bytes of memory per byte of text.
SLICE_BYTES = 1 << 20

# Families of ISO 639-1 codes. A language that is not named is a family of its own.
FAMILIES = {
    "austroasiatic": ("km", "vi"),
    "baltic": ("lt", "lv"),
    "bantu": ("ki", "ln", "lg", "nd", "ny", "rn", "rw", "sn", "ss", "st", "sw", "tn", "ts", "ve", "xh", "zu"),
    "celtic": ("br", "cy", "ga", "gd", "gv", "kw"),
    "constructed": ("eo", "ia", "ie", "io", "vo"),
    "cushitic": ("om", "so"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "east-asian": ("ja", "ko", "zh"),
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "indo-aryan": ("as", "bn", "dv", "gu", "hi", "mr", "ne", "or", "pa", "pi", "sa", "sd", "si", "ur"),
    "iranian": ("fa", "ku", "os", "ps", "tg"),
    "kra-dai": ("lo", "th", "za"),
    "malayo-polynesian": ("fj", "id", "jv", "mg", "mi", "ms", "sm", "su", "tl", "to", "ty"),
    "romance": ("an", "ca", "co", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro", "sc", "wa"),
    "semitic": ("am", "ar", "he", "mt", "ti"),
    "slavic": ("be", "bg", "bs", "cs", "cu", "hr", "mk", "pl", "ru", "sh", "sk", "sl", "sr", "uk"),
    "tibeto-burman": ("bo", "dz", "my"),
    "turkic": ("az", "ba", "cv", "kk", "ky", "tk", "tr", "tt", "ug", "uz"),
    "uralic": ("et", "fi", "hu", "se"),
    "west-african": ("ak", "bm", "ee", "ff", "ha", "ig", "tw", "wo", "yo"),
}

LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def family_of(language: str) -> str:
    """Family of a label; a regional one such as `pt-BR` belongs to its language's."""
    base = language.replace("_", "-").split("-")[0].lower()
    return next((f for f, members in FAMILIES.items() if base in members), f"only-{base}")


def _hashed(data: np.ndarray) -> list[np.ndarray]:
    """Feature numbers at every byte, one array per group length; the caller pads four blanks."""
    code, out = data[:-4].astype(np.uint32), []
    for n in range(2, max(GROUPS) + 1):
        code = code * np.uint32(0x01000193) + data[n - 1 : len(data) - 5 + n]
        if n in GROUPS:
            place = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            out.append(place + np.uint32(GROUPS.index(n) << BITS))
    return out


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of lower-cased texts, each led by one blank; bytes a text spans, and those that count.

    Four blanks behind a text count with it; three more keep its last group apart from the next text.
    """
    parts = [x.lower().encode() for x in texts]
    sizes = np.array([len(x) + 5 for x in parts], np.int64)
    data = np.frombuffer(b"".join(b" " + x + b"       " for x in parts) + b"    ", np.uint8)
    return LETTERS[data], sizes + 3, sizes


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sparse frequencies of one text: feature numbers and values."""
    data, _, (size,) = _joined([text])
    numbers, counts = np.unique(np.concatenate([h[:size] for h in _hashed(data)]), return_counts=True)
    return numbers.astype(np.int64), (SCALE * counts / size).astype(np.float64)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: float = 10.0, rounds: int = 30) -> tuple:
    """Linear SVM (squared hinge loss) by dual coordinate descent; classes weigh the same."""
    weights, bias = np.zeros(len(GROUPS) << BITS), 0.0
    alpha = np.zeros(len(rows))
    share = {s: len(signs) / (2 * max(1, (signs == s).sum())) for s in (-1, 1)}
    bound = np.array([1 / (2 * cost * share[int(s)]) for s in signs])
    norms = np.array([float(v @ v) + 1 for _, v in rows]) + bound
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at, values = rows[i]
            gradient = signs[i] * (weights[at] @ values + bias) - 1 + bound[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / norms[i])
            weights[at] += (new - alpha[i]) * signs[i] * values
            bias += (new - alpha[i]) * signs[i]
            alpha[i] = new
    return weights, bias


@dataclass(frozen=True)
class LanguageModel:
    """Weights of every machine, in the order of `names`: a family, or a pair of languages."""

    languages: tuple[str, ...]
    names: tuple[tuple[str, ...], ...]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, x in enumerate(texts) if x and any(map(str.isalpha, x))]
        labels, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not known or not self.languages:
            return labels, scores
        data, spans, sizes = _joined([texts[i] for i in known])
        hashed = _hashed(data)

        def chances(names: list[tuple[str, ...]], own: list[np.ndarray], rows) -> np.ndarray:
            """Chance of each machine's first side, for texts of these features."""
            starts, counted = np.cumsum(spans[rows]) - spans[rows], sizes[rows]
            edges, out = np.stack([starts, starts + counted], 1).ravel(), np.ones((len(names), len(counted)))
            for n, m in enumerate(map(self.names.index, names)):
                sums = sum(self.weights[m][h] for h in own)
                margins = np.add.reduceat(sums, edges)[::2] * SCALE / counted + self.bias[m]
                out[n] = 1 / (1 + np.exp(-STEEPNESS * np.clip(margins, -60, 60)))
            return out

        families = sorted({family_of(x) for x in self.languages})
        sure = chances([(f,) for f in families] if len(families) > 1 else [], hashed, slice(None))
        sure = sure if len(families) > 1 else np.ones((1, len(known)))
        best = sure.argmax(0)
        share = sure.max(0) / np.maximum(sure.sum(0), 1e-12)
        for n in np.unique(best):
            # Only texts of the family meet its pairs.
            rows, members = np.flatnonzero(best == n), [x for x in self.languages if family_of(x) == families[n]]
            mine = np.repeat(best == n, spans)
            pairs = list(combinations(members, 2))
            votes = dict.fromkeys(members, 0.0)
            own = [h[mine] for h in hashed] if pairs else []
            for (a, b), chance in zip(pairs, chances(pairs, own, rows)):
                votes[a] = votes[a] + chance
                votes[b] = votes[b] + 1 - chance
            stacked = np.array([votes[x] + np.zeros(len(rows)) for x in members]) / max(1, len(members) - 1)
            winner, level = stacked.argmax(0), stacked.max(0) if pairs else np.ones(len(rows))
            for j, w, sure_of in zip(rows, winner, share[rows] * level):
                labels[known[j]], scores[known[j]] = members[w], float(min(1.0, max(0.0, sure_of)))
        return labels, scores


def machines(languages: list[str]) -> list[tuple[str, ...]]:
    """One machine per family (where there are two), one per pair of languages within a family."""
    families = sorted({family_of(x) for x in languages})
    pairs = [p for f in families for p in combinations([x for x in languages if family_of(x) == f], 2)]
    return [(f,) for f in families if len(families) > 1] + pairs


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on labelled documents (text, lang); rows with a null label or text are no examples."""
    spark = docs.sparkSession
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(
        *key(), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text"
    )
    # Ranked by keys alone, in parts of each language first, so that a frequent one is many groups.
    order = [F.xxhash64("doc_id"), "doc_id", KEY[1]]
    part = F.pmod(F.xxhash64(*KEY), F.lit(PARTS))
    ranked = labelled.drop("text").distinct()
    for group in (["lang", part], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        ranked = ranked.withColumn("n", rank).filter(F.col("n") <= per_language).drop("n")
    # At most `per_language` keys of each language.
    chosen = F.broadcast(settle(ranked.select(*KEY, "lang")))
    sample = settle(labelled.join(chosen, [*KEY, "lang"]).select("doc_id", "lang", "text").distinct())
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    names = machines(languages)
    if not names:
        return LanguageModel(tuple(languages), (), np.zeros((0, 0), np.float32), np.zeros(0))
    roles = []
    for n, name in enumerate(names):
        for lang in languages:
            if len(name) == 1 or lang in name:
                roles.append((n, lang, 1 if (family_of(lang) if len(name) == 1 else lang) == name[0] else -1))
    roles = spark.createDataFrame(roles, "machine INT, lang STRING, sign INT")

    def fit_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["lang", "doc_id", "text"], kind="stable")
        weights, bias = fit([features(x) for x in rows.text], rows.sign.to_numpy())
        return pd.DataFrame(
            {"machine": rows.machine[:1], "weights": [weights.astype(np.float32).tobytes()], "bias": [bias]}
        )

    fitted = sample.join(F.broadcast(roles), "lang").groupBy("machine").applyInPandas(
        fit_group, "machine INT, weights BINARY, bias DOUBLE"
    )
    fitted = sorted(fitted.collect(), key=lambda r: r.machine)  # one row per machine, of fixed size
    weights = np.stack([np.frombuffer(bytes(r.weights), np.float32) for r in fitted])
    return LanguageModel(tuple(languages), tuple(names), weights, np.array([r.bias for r in fitted]))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Every row of `docs` as a struct `row`, with `_lang` and `_score`. Text alone decides.

    Null texts and texts without a letter are `und` with score 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in sliced(batches, "text", SLICE_BYTES):
            labels, scores = model.predict(piece.column("text").to_pylist())
            columns = [piece.column("row"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "_lang", "_score"])

    read = docs.select(F.struct("*").alias("row"), texts())
    return read.mapInArrow(run, read.select("row", F.lit("").alias("_lang"), F.lit(0.0).alias("_score")).schema)


def predictions(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learn from documents outside of the held-out fold, predict all."""
    out = held_out(5, 0)
    model = train(docs.filter(~out), per_language)
    named = identify(docs.select("doc_id", "text"), model).select(
        F.col("row")["doc_id"].cast("long").alias("doc_id"), "_lang", "_score"
    )
    return named.select(
        "doc_id", out.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score")
    )
