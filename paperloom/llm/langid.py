"""Multilingual language identification by expectation-maximisation.

Byte trigrams around each byte of a lower-cased letter are hashed to features; their
counts over all labelled texts give each language's smoothed feature likelihoods.  A
text is a mixture of languages: starting from the likeliest single language, the language
that would raise the likelihood fastest is added, the proportions are fitted by
expectation-maximisation, and the set grows while the log-likelihood gain exceeds its
penalty (any number of languages can be chosen).  Trigrams overlap, so that each letter
is seen three times; likelihoods are divided by three before they meet the penalty (half
the logarithm of the text's letters, and ``extra``).  A text is fitted by itself: what
else is in its batch, or in its partition, changes nothing.

The prediction is the language with the largest proportion (the first by code point on
ties); its score is that proportion.

Scale: counts are summed in each task to an array of languages x features, and
combined before the shuffle by (language, feature); the model that is broadcast has
at most ``max_model_bytes`` (features are halved until it fits, at least 1024).
Prediction is one scan; the letters that are fitted at a time get fewer with more
languages, so that a task's arrays stay of a size.  Very many texts of one language do no
harm.  More than ``max_languages`` labels are refused: they are the model's rows.

Defined results: a text that is null or has no letter is ``und`` with score 0 and no
mixture, as is every text if nothing is labelled.  A very long text is one mixture: its
arrays are bounded by the features, not by its length.  Labels that are null teach
nothing.  Repeated rows count each; an empty table gives an empty result.  Columns
other than those asked for with ``keep`` are not carried, so clashing names do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm._shared import small_batches
from paperloom.llm._words import slices, strings

_LETTER = re.compile(r"[^\W\d_]")
_BYTES = np.arange(256)
#: ASCII other than letters counts as a space.
_CLEAN = np.where(((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80), _BYTES, 0x20).astype(np.uint8)
UNKNOWN = "und"


def features(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the trigram around every byte of a letter."""
    parts = [b"" if t is None else t.lower().encode("utf-8", "surrogatepass") for t in texts]
    # spaces around each text, so that first and last letters form trigrams of their own
    data = _CLEAN[np.frombuffer(b" " + b" ".join([*parts, b""]), dtype=np.uint8)]
    lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    at = np.flatnonzero(data[1:-1] != 0x20) + 1
    wide = data.astype(np.uint32)
    code = wide[at - 1] << np.uint32(16) | wide[at] << np.uint32(8) | wide[at + 1]
    hashed = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    return np.searchsorted(np.cumsum(lengths), at - 1, side="right"), hashed.astype(np.int64)


def feature_bits(languages: int, max_model_bytes: int, most: int = 16, least: int = 10) -> int:
    bits = most
    while bits > least and languages * 4 * (1 << bits) > max_model_bytes:
        bits -= 1
    return bits


def _counted(batches: Iterator[pa.RecordBatch], languages: list[str], bits: int) -> Iterator[pa.RecordBatch]:
    code = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(languages), 1 << bits), np.int64)
    for batch in batches:
        for part in slices(batch, "__text"):
            owner, feature = features(strings(part, "__text"), bits)
            lang = np.array([code[x] for x in part.column("__lang").to_pylist()])
            flat = lang[owner] * (1 << bits) + feature
            counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
    rows, cols = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(cols.astype(np.int32)), pa.array(counts[rows, cols])], names=["lang", "feature", "n"])


class Model:
    """Languages in order, and the features' likelihoods in each (feature by language)."""

    def __init__(self, languages: list[str], likelihood: np.ndarray, bits: int):
        self.languages, self.likelihood, self.bits = languages, likelihood, bits


def fit(df: DataFrame, labelled: Column, text: str = "text", lang: str = "lang", max_model_bytes: int = 1 << 26, max_languages: int = 10_000, smooth: float = 0.5) -> Model:
    """The model of the rows where ``labelled`` holds and the label isn't null."""
    small_batches(df.sparkSession)
    rows = df.where(labelled & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("__lang"), F.col(text).alias("__text"))
    languages = sorted(r[0] for r in rows.select("__lang").distinct().limit(max_languages + 1).collect())
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    bits = feature_bits(max(1, len(languages)), max_model_bytes)
    counts = np.zeros((len(languages), 1 << bits))
    if languages:
        summed = rows.mapInArrow(partial(_counted, languages=languages, bits=bits), "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
        found = summed.toArrow()  # languages x features rows at most
        counts[found["lang"].to_numpy(), found["feature"].to_numpy()] = found["n"].to_numpy()
    seen = max(1, int((counts.sum(axis=0) > 0).sum()))
    likelihood = (counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * seen)
    return Model(languages, np.ascontiguousarray(likelihood.T.astype(np.float32)), bits)


def mixtures(texts: list[str | None], model: Model, extra: float = 3.0, rounds: int = 30, settle: float = 1e-3) -> np.ndarray:
    """Language proportions of each text (rows of zeros for texts without a letter)."""
    n_texts, n_lang = len(texts), len(model.languages)
    mix = np.zeros((n_texts, n_lang))
    if not n_lang:
        return mix
    owner, feature = features([t if t and _LETTER.search(t) else None for t in texts], model.bits)
    if not len(owner):
        return mix
    key, counts = np.unique(owner << model.bits | feature, return_counts=True)
    owner, weight = key >> model.bits, counts.astype(np.float64)
    p = model.likelihood[key & ((1 << model.bits) - 1)].astype(np.float64)
    texts_in, starts = np.unique(owner, return_index=True)
    total = np.add.reduceat(weight, starts)
    best_log = np.add.reduceat(np.log(p) * weight[:, None], starts, axis=0)
    first = best_log.argmax(axis=1)
    mix[texts_in, first] = 1.0
    log_now = best_log[np.arange(len(texts_in)), first]
    chosen = np.zeros((len(texts_in), n_lang), bool)
    chosen[np.arange(len(texts_in)), first] = True
    penalty = 0.5 * np.log(np.maximum(total / 3, 1.0)) + extra
    active = np.arange(len(texts_in))
    for _ in range(n_lang - 1):
        if not len(active):
            break
        index, place, begin = _rows_of(active, starts, len(owner))
        share, own = mix[texts_in[active]], p[index]
        now = (own * share[place]).sum(axis=1)
        # the rate at which each language, added at proportion 0, raises the likelihood
        rate = np.add.reduceat(own / now[:, None] * weight[index, None], begin, axis=0) / total[active, None] - 1.0
        rate[chosen[active]] = -np.inf
        added = rate.argmax(axis=1)
        go = rate[np.arange(len(active)), added] > 1e-6
        active, added, share = active[go], added[go], share[go]
        if not len(active):
            break
        index, place, begin = _rows_of(active, starts, len(owner))
        own = p[index]
        share = share * 0.9
        share[np.arange(len(active)), added] = 0.1
        share, log_new = _fit_shares(own, weight[index], place, begin, share, total[active], rounds, settle)
        gain = (log_new - log_now[active]) / 3 > penalty[active]
        active, added = active[gain], added[gain]
        mix[texts_in[active]] = share[gain]
        log_now[active] = log_new[gain]
        chosen[active, added] = True
    return mix


def _fit_shares(own: np.ndarray, weight: np.ndarray, place: np.ndarray, begin: np.ndarray, share: np.ndarray, total: np.ndarray, rounds: int, settle: float) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of each text's shares, and the log-likelihoods."""
    live, new_place, new_begin = np.arange(len(total)), place, begin
    rows = np.arange(len(place))
    for _ in range(rounds):
        parts = own[rows] * share[live][new_place]
        new = np.add.reduceat(parts * (weight[rows] / parts.sum(axis=1))[:, None], new_begin, axis=0) / total[live, None]
        moves = np.abs(new - share[live]).max(axis=1) >= settle  # a text that has settled stays as it is
        share[live] = new
        if not moves.any():
            break
        live = live[moves]
        rows, new_place, new_begin = _rows_of(live, begin, len(place))
    now = (own * share[place]).sum(axis=1)
    return share, np.add.reduceat(np.log(now) * weight, begin)


def _rows_of(active: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the feature rows of the active texts, their place among those, and each one's first row."""
    ends = np.append(starts[1:], n)
    sizes = (ends - starts)[active]
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.repeat(np.arange(len(active)), sizes)
    return np.arange(sizes.sum()) - begin[place] + starts[active][place], place, begin


def identify(df: DataFrame, model: Model, keep: list[Column | str], text: str = "text") -> DataFrame:
    """The ``keep`` columns of every row with lang_pred, score and the mixture (``en:0.70,fr:0.30``)."""
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.likelihood, model.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        letters = max(1, min(200_000, 16_000_000 // max(1, len(own.languages))))
        for batch in batches:
            for part in slices(batch, "__text", most_chars=letters):
                shares = mixtures(strings(part, "__text"), own)
                known = shares.sum(axis=1) > 0 if shares.size else np.zeros(part.num_rows, bool)
                top = shares.argmax(axis=1) if shares.size else np.zeros(part.num_rows, np.int64)
                labels = [own.languages[i] if k else UNKNOWN for i, k in zip(top, known, strict=True)]
                score = np.clip(shares[np.arange(len(top)), top], 0.0, 1.0).round(9) if shares.size else np.zeros(part.num_rows)
                mixture = [",".join(f"{own.languages[i]}:{row[i]:.2f}" for i in np.argsort(-row, kind="stable") if row[i] >= 0.005) for row in shares]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, pa.string())], names=[*part.schema.names[:-1], "lang_pred", "score", "mixture"])

    rows = df.select(*keep, F.col(text).alias("__text"))
    schema = rows.drop("__text").schema.add("lang_pred", "string", False).add("score", "double", False).add("mixture", "string", False)
    return rows.mapInArrow(run, schema)
