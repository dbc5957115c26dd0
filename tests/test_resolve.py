"""Entity resolution on small name sets, against comparing every pair."""

import random

import numpy as np
from pyspark.sql import functions as F

from signalbook.operators import resolve, similar


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def names(rng, n):
    base = ["".join(rng.choice("abcdeilnorst ") for _ in range(rng.randint(1, 18))).strip() for _ in range(n)]
    return sorted({" ".join(b.split()) for b in base if b})


def mutate(rng, name):
    chars = list(name)
    for _ in range(rng.randint(0, 6)):
        at = rng.randrange(len(chars) + 1)
        if rng.random() < 0.5 and at < len(chars):
            chars[at] = rng.choice("aeixz")
        elif rng.random() < 0.5 and len(chars) > 1 and at < len(chars):
            del chars[at]
        else:
            chars.insert(at, rng.choice("aeixz"))
    return " ".join("".join(chars).split()) or "x"


def test_no_pair_is_missed(spark):
    rng = random.Random(11)
    known = names(rng, 70)
    mentions = sorted({mutate(rng, rng.choice(known)) for _ in range(80)} | set(names(rng, 20)))
    registry = spark.createDataFrame([("service", f"S{i:03}", n, n) for i, n in enumerate(known)], "entity_type string, canonical_id string, canonical_name string, known string")
    asked = spark.createDataFrame([("service", m) for m in mentions], "entity_type string, norm string")
    sort = lambda s: " ".join(sorted(s.split()))
    rules = {
        "indel": lambda a, b: 200.0 * lcs(a, b) / (len(a) + len(b)),
        "levenshtein": lambda a, b: 100.0 * (1 - edit(a, b) / max(len(a), len(b))),
    }
    for method, rule in rules.items():
        for lowest in (60, 85):
            want = {(m, k) for m in mentions for k in known if rule(sort(m), sort(k)) >= lowest - 1e-7}
            rows = resolve.similar_names(asked, registry, lowest, method).select("norm", "known").collect()
            assert len(rows) == len(set(rows)), "a pair came twice"
            assert {tuple(r) for r in rows} == want, (method, lowest)


def test_subsequence_of_long_names(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choice("abc") for _ in range(n)), "".join(rng.choice("abc") for _ in range(m))) for n, m in ((1, 1), (5, 9), (62, 63), (63, 63), (64, 10), (200, 150), (10, 100), (0, 4), (126, 127))]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similar.common_subsequence("a", "b").alias("n")).collect()
    assert [r.n for r in got] == [lcs(r.a, r.b) for r in got]


def all_scores(mentions, known, method):
    """Score of every pair, by plain dynamic programming over all known names at once."""
    width = max(map(len, known))
    letters = np.array([[ord(c) for c in k.ljust(width, "\0")] for k in known])
    size = np.array([len(k) for k in known])
    out = np.empty((len(mentions), len(known)))
    for i, m in enumerate(mentions):
        lev = method == "levenshtein"
        row = np.tile(np.arange(width + 1) if lev else np.zeros(width + 1, int), (len(known), 1))
        for at, c in enumerate(m, 1):
            hit = letters == ord(c)
            new = np.empty_like(row)
            new[:, 0] = at if lev else 0
            for j in range(1, width + 1):
                if lev:
                    new[:, j] = np.minimum(np.minimum(row[:, j], new[:, j - 1]) + 1, row[:, j - 1] + ~hit[:, j - 1])
                else:
                    new[:, j] = np.where(hit[:, j - 1], row[:, j - 1] + 1, np.maximum(row[:, j], new[:, j - 1]))
            row = new
        end = row[np.arange(len(known)), size]
        out[i] = 100.0 * (1 - end / np.maximum(size, len(m))) if lev else 200.0 * end / (size + len(m))
    return out


def company_names(rng, n):
    """Two or three made-up words each, with the letter frequencies of English and shared endings."""
    letters, weights = "etaoinshrdlcumwfgypbvkjxqz", [13, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3, 3, 2, 2, 2, 2, 2, 2, 1, 1, 1, 1, 1, 1, 1]
    word = lambda: "".join(rng.choices(letters, weights, k=rng.randint(3, 9)))
    ends = ["bank", "systems", "group", "labs", "energy", "media"]
    out = set()
    while len(out) < n:
        out.add(" ".join(sorted([word(), word()] + ([rng.choice(ends)] if rng.random() < 0.4 else []))))
    return sorted(out)


def test_recall_and_candidates_on_three_thousand_names(spark):
    rng = random.Random(5)
    known = company_names(rng, 3000)
    sort = lambda s: " ".join(sorted(s.split()))
    mentions = sorted({sort(mutate(rng, rng.choice(known))) for _ in range(300)} | set(company_names(rng, 100)))
    registry = spark.createDataFrame([("service", f"S{i:04}", n, n) for i, n in enumerate(known)], "entity_type string, canonical_id string, canonical_name string, known string")
    asked = spark.createDataFrame([("service", m) for m in mentions], "entity_type string, norm string")
    sides = asked.withColumnRenamed("norm", "_a"), registry.select("entity_type", F.col("known").alias("_b"))
    pairs = len(mentions) * len(known)
    for method in ("indel", "levenshtein"):
        score = all_scores(mentions, known, method)
        for lowest in (60, 85):
            want = {(mentions[i], known[j]) for i, j in zip(*np.nonzero(score >= lowest - 1e-6))}
            rows = [tuple(r) for r in resolve.similar_names(asked, registry, lowest, method).select("norm", "known").collect()]
            assert len(rows) == len(set(rows)) and set(rows) == want
        assert similar.segment_candidates(*sides, 85, method).count() < 0.01 * pairs
        assert compared(mentions, known, 60, method) < 0.05 * pairs


def compared(mentions, known, lowest, method):
    """Pairs that the blocks, one per length band, leave to be compared."""
    bands = [{}, {}]
    for side, held in zip(bands, (mentions, known)):
        for name in held:
            side.setdefault(int(np.log(len(name)) * 8 + 1e-9), []).append(name)
    return sum(len(similar.block_candidates(np.array(a), np.array(b), lowest, method)[0]) for a in bands[0].values() for b in bands[1].values())


REGISTRY = [("customer", "C1", "Acme Corp", ["Acme Global"]), ("customer", "C2", "Blue Ocean Bank", []), ("customer", "C3", "Initech", [])]
MENTIONS = ["ACME CORP", "Acme, Inc.", "acme global ltd", "Bank Blue Ocean", "Blue Ocean Bnk", "Inittech", "Wayne Works", "wayne works Ltd", "Blue Ocan Bak", "Ltd."]


def decide(spark, mentions, method="indel"):
    rows = spark.createDataFrame([("customer", m, f"D{i}", i) for i, m in enumerate(mentions)], "entity_type string, raw_value string, document_id string, at int")
    registry = spark.createDataFrame(REGISTRY, "entity_type string, canonical_id string, name string, aliases array<string>")
    decisions = resolve.resolve_names(resolve.distinct_names(rows, "at"), registry, method)
    return rows, decisions


def test_cascade(spark):
    rows, decisions = decide(spark, MENTIONS)
    got = {r.raw_value: r for r in decisions.collect()}
    assert len(got) == len(MENTIONS)
    assert (got["ACME CORP"].resolution_method, got["ACME CORP"].confidence) == ("exact", 1.0)
    assert (got["Acme, Inc."].resolution_method, got["Acme, Inc."].canonical_id) == ("normalized", "C1")
    assert got["acme global ltd"].canonical_id == "C1" and got["acme global ltd"].confidence == 0.95
    assert (got["Bank Blue Ocean"].score, got["Bank Blue Ocean"].confidence) == (100.0, 0.9)
    assert got["Blue Ocean Bnk"].canonical_id == "C2" and got["Inittech"].canonical_id == "C3"
    new = got["Wayne Works"]
    assert new.is_new_entity and new.canonical_id.startswith("CUST_")
    assert got["wayne works Ltd"].canonical_id == new.canonical_id and got["wayne works Ltd"].canonical_name == "Wayne Works"
    assert got["Ltd."].is_new_entity
    log = resolve.resolve_mentions(rows, decisions)
    assert log.count() == len(MENTIONS)
    again = {tuple(r) for r in decide(spark, MENTIONS[::-1])[1].select("raw_value", "canonical_id", "resolution_method").collect()}
    assert again == {(r.raw_value, r.canonical_id, r.resolution_method) for r in got.values()}
