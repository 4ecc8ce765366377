"""Language ID in two levels: the family first, then the language within it.

Texts become hashed byte 2- and 3-grams (square roots of their shares, so that
every vector has length one and long texts weigh as much as short ones). Linear
support vector machines, fitted here by dual coordinate descent, decide: one
against the rest for the families, one against one inside a family.

The model is fitted on a bounded sample, at most ``sample_rows`` labelled texts in
all, drawn evenly from the labels by a hash. Prediction reads every whole text.

Defined cases: a null text, an empty one or one without letters is ``und`` with
score 0; without any labelled row everything is ``und``. Null labels and texts
without letters are not learned from. A label that the family table does not know
belongs to the family ``other``. Repeated rows are predicted alike; other columns
pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodloom.llm.common import bound_batches, give_back, joined, steps, utf8

# Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "indic": "bn gu hi mr ne pa sa si ur",
    "semitic": "am ar he mt",
    "turkic": "az kk ky tr tt uz",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
}
UNDETERMINED = "und"
DIMS = 4096
SAMPLE_ROWS = 2400
#: Bytes of text that one step handles.
STEP = 1 << 20


def family_of(label: str) -> str:
    code = label.lower().split("-")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), "other")


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


def has_letter(data: np.ndarray) -> bool:
    """Any letter of any script in lower-cased UTF-8 bytes."""
    if _LETTER[data].any():
        return True
    return any(c.isalpha() for c in data.tobytes().decode("utf-8", "replace"))


def profiles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of whole texts, and which texts have a letter."""
    data, offsets = joined(texts)
    out = np.zeros((len(texts), DIMS), np.float32)
    letters = np.zeros(len(texts), bool)
    sizes = np.diff(offsets)
    for a, b in steps(sizes + 8192, STEP):
        low = _LOWER[data[offsets[a] : offsets[b]]]
        start = offsets[a:b] - offsets[a]
        for k, i in enumerate(range(a, b)):
            letters[i] = has_letter(low[start[k] : start[k] + sizes[i]])
        row = np.repeat(np.arange(b - a, dtype=np.int32), sizes[a:b])
        counts = np.zeros((b - a) * DIMS, np.float64)
        # A long text goes part by part; a gram belongs to the part it starts in.
        for lo in range(0, len(low), STEP):
            for n in (2, 3):
                part, rows = low[lo : lo + STEP + n - 1].astype(np.uint32), row[lo : lo + STEP + n - 1]
                if len(part) < n:
                    continue
                gram = part[: len(part) - n + 1]
                for k in range(1, n):
                    gram = (gram << 8) | part[k : len(part) - n + 1 + k]
                whole = rows[: len(gram)] == rows[n - 1 :]
                slot = (gram * np.uint32(2654435761 + 2 * n)) >> np.uint32(20)
                at = rows[: len(gram)][whole].astype(np.int64) * DIMS + slot[whole]
                counts += np.bincount(at, minlength=len(counts))
        counts = counts.reshape(b - a, DIMS)
        total = counts.sum(1, keepdims=True)
        out[a:b] = np.sqrt(counts / np.maximum(total, 1))
    return out, letters


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 30, c: float = 10.0) -> np.ndarray:
    """Weights and bias of a linear SVM (hinge loss, dual coordinate descent), y in -1, 1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1) / square[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


class Model:
    """Family machines, and pair machines inside each family."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.labels = sorted(set(labels))
        self.families = sorted({family_of(l) for l in self.labels})
        lab = np.array(labels)
        fam = np.array([family_of(l) for l in labels])
        sign = lambda hit: np.where(hit, 1.0, -1.0)
        self.pairs = [
            (i, j)
            for i, a in enumerate(self.labels)
            for j, b in enumerate(self.labels)
            if i < j and family_of(a) == family_of(b)
        ]
        rows = [fit_svm(x, sign(fam == f)) for f in self.families] if len(self.families) > 1 else []
        for i, j in self.pairs:
            some = (lab == self.labels[i]) | (lab == self.labels[j])
            rows.append(fit_svm(x[some], sign(lab[some] == self.labels[i])))
        self.weights = np.array(rows).reshape(len(rows), DIMS + 1).astype(np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the label and score of each row."""
        n, m = len(x), len(self.labels)
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1] if len(self.weights) else np.zeros((n, 0))
        sure = 1 / (1 + np.exp(-np.clip(3.0 * margin.astype(np.float64), -30, 30)))
        one = len(self.families) == 1
        skip = 0 if one else len(self.families)
        family = np.zeros(n, int) if one else margin[:, :skip].argmax(1)
        score = np.ones(n) if one else sure[np.arange(n), family]
        # Votes of the pair machines, ties by the summed certainty, then by label.
        votes = np.zeros((n, m))
        trust = np.zeros((n, m))
        for k, (i, j) in enumerate(self.pairs):
            p = sure[:, skip + k]
            votes[:, i] += p >= 0.5
            votes[:, j] += p < 0.5
            trust[:, i] += p
            trust[:, j] += 1 - p
        where = np.array([self.families.index(family_of(l)) for l in self.labels])
        mine = where[None, :] == family[:, None]
        best = np.where(mine, votes + trust / (2 * m), -1.0).argmax(1)
        rivals = np.bincount(where, minlength=len(self.families))[family] - 1
        inner = np.where(rivals > 0, trust[np.arange(n), best] / np.maximum(rivals, 1), 1.0)
        return best, score * inner


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Model of (text, lang) rows; None if there is nothing to learn from."""
    bound_batches(labelled.sparkSession)
    some = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in some.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    each = max(1, int(sample_rows / 1.5) // len(counts))
    share = F.create_map(*[x for l, n in counts.items() for x in (F.lit(l), F.lit(min(1.0, each / n)))])
    draw = F.pmod(F.xxhash64(F.lit("draw"), "doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))

    @F.arrow_udf("binary")
    def vector(texts: pa.Array) -> pa.Array:
        return pa.array([v.tobytes() for v in profiles(texts)[0]], pa.binary())

    rows = (
        some.where(draw < share[F.col("lang")])
        .limit(sample_rows)
        .select("lang", vector(utf8()).alias("v"))
        .collect()
    )
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["v"])))
    return Model(np.array([np.frombuffer(r["v"], np.float32) for r in rows]), [r["lang"] for r in rows])


def predicted(model: Model | None, text: str = "text") -> Column:
    """struct(lang, score) of a text column."""
    kind = "struct<lang:string,score:double>"
    if model is None:
        return F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"))

    @F.arrow_udf(kind)
    def predict(texts: pa.Array) -> pa.Array:
        langs: list[str] = []
        scores: list[np.ndarray] = [np.empty(0)]
        for a in range(0, len(texts), 512):
            x, letters = profiles(texts[a : a + 512])
            best, score = model.predict(x)
            langs += [model.labels[k] if ok else UNDETERMINED for k, ok in zip(best, letters)]
            scores.append(np.where(letters, score, 0.0))
            del x
        give_back()
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(np.concatenate(scores), pa.float64())],
            ["lang", "score"],
        )

    return predict(utf8(text))


def held_out() -> Column:
    """crc32(doc_id as text) mod 5 is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those not held out."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return docs.select("doc_id", held_out().alias("held_out"), predicted(model).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")
    )


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents, without those that are in no language: null, empty or without letters."""
    columns = docs.columns
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return (
        docs.withColumn("_p", predicted(model)).where(F.col("_p.lang") != UNDETERMINED).select(columns)
        if model
        else docs.where(F.col("text").rlike(r"\p{L}"))
    )
