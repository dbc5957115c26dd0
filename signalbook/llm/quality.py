"""Document quality by attention over passages (multiple-instance learning).

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage of the whole text is
encoded from counts of its characters and words; a gated attention network, learnt from document
labels alone, weighs the encodings, and a logistic unit scores their weighted sum:

    h = tanh(x W + b)      a = softmax over the bag of ((tanh(h V) * sigmoid(h U)) w)
    score = sigmoid((sum of a h) c + d)

Passages are encoded in the tasks that read the texts.  The network is fitted on the driver from a
bounded sample of labelled documents and has a few thousand numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbook.llm.common import by_value, text_of

PASSAGE_WORDS = 64
#: Most labelled documents used for fitting, always whole; no more are chosen once they have so many
#: passages together.
TRAIN_DOCUMENTS = 4000
TRAIN_PASSAGES = 60_000
THRESHOLD = 0.3
HIDDEN, GATES = 16, 8
ROUNDS, STEP, DECAY = 400, 0.02, 1e-4
#: Bytes of text encoded at a time inside a task.
CHUNK_BYTES = 2_000_000

CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\v\f\r", b".", b",;:",
    b"!?", b"'\"()-", b"|", b"#$%&*+/<=>@[\\]^_`{}~", bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0)),
)
OTHER = len(CLASSES)
FEATURES = OTHER + 1 + 8
_CLASS_OF = np.full(256, OTHER, np.int64)
for _i, _bytes in enumerate(CLASSES):
    _CLASS_OF[list(_bytes)] = _i
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multipliers by position in the word, for hashing words.
_PLACE = (np.random.default_rng(7).integers(0, 2**63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (passages x FEATURES) and the number of passages of each text.

    A text without words is one passage of zeros.
    """
    raw = [text.encode("utf-8", "surrogatepass") for text in texts]
    size = np.array([len(r) + 1 for r in raw], np.int64)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    first = np.concatenate([[0], np.cumsum(size)])
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[0::2], edge[1::2]
    doc = np.searchsorted(first, start, "right") - 1
    words = np.bincount(doc, minlength=len(texts))
    within = np.arange(len(start)) - np.concatenate([[0], np.cumsum(words)])[doc]
    opens = within % PASSAGE_WORDS == 0
    passage = np.cumsum(opens) - 1
    counts = np.maximum(-(-words // PASSAGE_WORDS), 1)
    total = int(counts.sum())
    out = np.zeros((total, FEATURES), np.float32)
    if not len(start):
        return out, counts
    p_start = start[opens]
    p_end = end[np.append(np.flatnonzero(opens)[1:] - 1, len(end) - 1)]
    length = p_end - p_start
    n = len(p_start)
    at = np.repeat(p_start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    seen = np.bincount(np.repeat(np.arange(n) * (OTHER + 1), length) + _CLASS_OF[data[at]], minlength=n * (OTHER + 1))
    share = seen.reshape(n, OTHER + 1) / length[:, None]
    # words: hash, length, case of the first letter, last byte
    w_len = end - start
    place = np.arange(len(at_words := np.repeat(start, w_len))) - np.repeat(np.concatenate([[0], np.cumsum(w_len)[:-1]]), w_len)
    values = (data[at_words + place].astype(np.uint64) + np.uint64(1)) * _PLACE[place & 63]
    hashed = np.add.reduceat(values, np.concatenate([[0], np.cumsum(w_len)[:-1]]))
    in_passage = np.bincount(passage, minlength=n).astype(float)
    mean = lambda x: np.bincount(passage, x, minlength=n) / in_passage
    again = hashed[1:] == hashed[:-1]
    again &= passage[1:] == passage[:-1]
    order = np.lexsort((hashed, passage))
    new = np.ones(len(order), bool)
    new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order], new, minlength=n) / in_passage
    head, tail = _CLASS_OF[data[start]], _CLASS_OF[data[end - 1]]
    length_mean = mean(w_len)
    extra = np.stack(
        [
            length_mean / 10,
            np.sqrt(np.maximum(mean(w_len.astype(float) ** 2) - length_mean**2, 0)) / 10,
            distinct,
            mean(np.append(False, again)),
            mean(head == 1),
            mean((tail >= 7) & (tail <= 10)),
            mean(tail == 5),
            np.log1p(in_passage) / 4,
        ],
        axis=1,
    )
    kept = np.repeat(words > 0, counts)
    out[kept] = np.concatenate([share, extra], axis=1)
    return out, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _bag_sums(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)


def attend(model: dict, x: np.ndarray, counts: np.ndarray) -> dict:
    """Forward pass: scores per bag and attention per passage, with what the backward pass needs."""
    x = (x - model["mean"]) / model["scale"]
    h = np.tanh(x @ model["W"] + model["b"])
    t, g = np.tanh(h @ model["V"]), _sigmoid(h @ model["U"])
    e = np.exp(np.clip((t * g) @ model["w"], -30, 30))
    a = e / np.repeat(_bag_sums(e, counts), counts)
    z = _bag_sums(a[:, None] * h, counts)
    return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ model["c"] + model["d"])}


def fit(x: np.ndarray, counts: np.ndarray, label: np.ndarray, seed: int = 11) -> dict:
    """The network fitted by Adam on whole passes; log loss of the document labels only."""
    rng = np.random.default_rng(seed)
    model = {"mean": x.mean(axis=0), "scale": np.maximum(x.std(axis=0), 1e-3)}
    shapes = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATES), "U": (HIDDEN, GATES), "w": (GATES,), "c": (HIDDEN,), "d": ()}
    learnt = {k: rng.normal(0, 1 / np.sqrt(s[0]) if len(s) == 2 else 0.1, s) for k, s in shapes.items()}
    learnt["d"] = np.log((label.mean() + 1e-3) / (1 - label.mean() + 1e-3))
    first = {k: np.zeros_like(v) for k, v in learnt.items()}
    second = {k: np.zeros_like(v) for k, v in learnt.items()}
    bag = np.repeat(np.arange(len(counts)), counts)
    for step in range(1, ROUNDS + 1):
        s = attend(model | learnt, x, counts)
        err = (s["score"] - label) / len(label)
        dz = err[:, None] * learnt["c"]
        dh = s["a"][:, None] * dz[bag]
        da = (s["h"] * dz[bag]).sum(axis=1)
        de = s["a"] * (da - np.add.reduceat(s["a"] * da, np.concatenate([[0], np.cumsum(counts)[:-1]]))[bag])
        dtg = de[:, None] * learnt["w"]
        dt, dg = dtg * s["g"] * (1 - s["t"] ** 2), dtg * s["t"] * s["g"] * (1 - s["g"])
        dh = (dh + dt @ learnt["V"].T + dg @ learnt["U"].T) * (1 - s["h"] ** 2)
        grad = {
            "W": s["x"].T @ dh, "b": dh.sum(axis=0), "V": s["h"].T @ dt, "U": s["h"].T @ dg,
            "w": (s["t"] * s["g"]).T @ de, "c": s["z"].T @ err, "d": err.sum(),
        }
        for k, v in grad.items():
            v = v + DECAY * learnt[k]
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.999 * second[k] + 0.001 * v * v
            learnt[k] = learnt[k] - STEP * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model | learnt


def _chunks(batch: pa.RecordBatch, text_col: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of the batch in runs of about CHUNK_BYTES of text, with their texts (null as empty)."""
    texts = [text or "" for text in batch.column(text_col).to_pylist()]
    at = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK_BYTES or i == len(texts) - 1:
            yield batch.slice(at, i + 1 - at), texts[at : i + 1]
            at, size = i + 1, 0


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, quality, place, the features of all passages of each text, and their number."""
    for batch in batches:
        for part, texts in _chunks(batch):
            x, counts = encode(texts)
            bags = [bag.astype(np.float32).tobytes() for bag in np.split(x, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in ("doc_id", "quality", "place")], pa.array(bags, pa.binary()), pa.array(counts, pa.int64())],
                ["doc_id", "quality", "place", "bag", "passages"],
            )


def judge(model: dict | float, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: score, passages, the passage with the largest attention weight, that weight."""
    x, counts = encode(texts)
    if isinstance(model, float):
        return np.full(len(texts), model), counts, np.zeros(len(texts), np.int64), 1.0 / counts
    s = attend(model, x, counts)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    place = np.array([int(np.argmax(s["a"][a : a + c])) for a, c in zip(starts, counts)], np.int64)
    return s["score"], counts, place, s["a"][starts + place]


def _scorer(model: dict | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _chunks(batch):
                found = judge(model, texts)
                kinds = (pa.float64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(v, k) for v, k in zip(found, kinds)]],
                    ["doc_id", "score", "passages", "top_passage", "top_weight"],
                )

    return run


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS, passages: int = TRAIN_PASSAGES) -> dict | float:
    """A network fitted on at most ``most`` labelled documents whose remainder is not 0.

    Takes the smallest hashes of the id, so reruns agree, and every document with all its passages;
    once these are ``passages`` or more, no further document is taken.  Null labels are passed over;
    an id that is labelled twice counts with its larger label.  Without both labels the answer is the
    constant share of label 1 (0.5 without any).
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0))
    chosen = (
        usable.groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
        .withColumn("place", F.xxhash64("doc_id"))
        .orderBy("place", "doc_id").limit(most)
    )
    order = ["place", "doc_id", "bag"]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        docs.select("doc_id", text_of("text").alias("text")).join(chosen, "doc_id")
        .select("doc_id", "quality", "place", "text")
        .mapInArrow(_encoded, f"doc_id {_kind(docs)}, quality int, place long, bag binary, passages long")
        .orderBy(*order)
        .limit(most)
        # At most ``most`` rows are ordered here.
        .withColumn("before", F.coalesce(F.sum("passages").over(before), F.lit(0)))
        .where(F.col("before") < passages)
        .select("quality", "bag")
        .collect()
    )
    label = np.array([row["quality"] for row in rows], float)
    if len(set(label)) < 2:
        return float(label[0]) if len(label) else 0.5
    bags = [np.frombuffer(row["bag"], np.float32).reshape(-1, FEATURES) for row in rows]
    return fit(np.concatenate(bags).astype(float), np.array([len(b) for b in bags]), label)


def score(docs: DataFrame, model: dict | float) -> DataFrame:
    """doc_id, score, passages, top_passage, top_weight: one row per row of ``docs``.

    Only the text is looked at, whole; a null text counts as empty, and an empty text is scored as
    one passage without words.  top_passage has the largest attention weight.
    """
    schema = f"doc_id {_kind(docs)}, score double, passages long, top_passage long, top_weight double"
    return docs.select("doc_id", "text").mapInArrow(_scorer(model), schema)


def score_and_decide(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns of ``score``."""
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "passages",
        "top_passage",
        "top_weight",
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _chunks(batch):
                yield part.filter(pa.array(judge(model, texts)[0] >= threshold))

    return docs.mapInArrow(run, docs.schema)


by_value(__name__)
