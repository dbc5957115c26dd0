"""Line dedup with copies counted as one page: boilerplate goes, near copies stay whole."""

import random

import corpus_pipeline
from signalbook.llm import lines

DOCS = "doc_id long, source string, text string, n_chars int"


def sentence(rng, words):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(words))


def crowded(rng, copies=100, others=400):
    """Pages of one source with a header each, and copies of a page of four lines with one word edited each."""
    page = [sentence(rng, 40) for _ in range(4)]
    rows = []
    for i in range(copies):
        mine = list(page)
        place = rng.randrange(4)
        words = mine[place].split()
        words[rng.randrange(40)] = f"edit{i}"
        mine[place] = " ".join(words)
        rows.append((i, "a", "\n".join(mine)))
    rows += [(copies + i, "a", "\n".join(["Home | About", *[sentence(rng, 20) for _ in range(4)]])) for i in range(others)]
    return [(*r, len(r[2])) for r in rows]


def test_copies_stay_whole_and_one_is_kept(spark):
    rows = crowded(random.Random(1))
    before = {r[0]: r[2] for r in rows}
    cleaned = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, DOCS), "").cache()
    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cleaned.collect()}
    assert len(after) == 500
    assert all(after[i][0] == before[i] for i in range(100))
    assert all("Home | About" not in after[i][0] and after[i][0] == before[i].split("\n", 1)[1] for i in range(100, 500))
    assert all(size == len(text) for text, size in after.values())
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, cleaned, "").collect()}
    assert len([i for i in kept if i < 100]) == 1 and len(kept) == 401
    cleaned.unpersist()


def folded(rows, ratio, least):
    """The rule by plain sets."""
    found = {}
    for host in {r[1] for r in rows}:
        pages = {}
        for r in rows:
            if r[1] == host:
                held = frozenset(x.strip(" ") for x in (r[2] or "").split("\n") if x.strip(" "))
                pages[held] = held
        holding = {}
        for held in pages:
            for x in held:
                holding[x] = holding.get(x, 0) + 1
        common = {x for x, n in holding.items() if n >= least}
        units = {}
        for held in pages:
            shared = held & common
            copied = sum(map(len, shared)) * 2 > sum(map(len, held))
            # Of lines equally rare any may name the group; the rows are made without such ties.
            unit = min(shared, key=lambda x: holding[x]) if copied else held
            units.setdefault((copied, unit), set()).update(shared)
        for x in common:
            n = sum(x in held for held in units.values())
            if n >= least and n >= ratio * len(units):
                found.setdefault(host, set()).add(x)
    return found


def test_equals_plain_sets(spark):
    rng = random.Random(5)
    rows = []
    for host, size in (("a", 60), ("b", 25), (None, 30)):
        frame = [f"frame {host} {k}" for k in range(4)]
        for i in range(size):
            own = [sentence(rng, rng.randrange(1, 12)) for _ in range(rng.randrange(0, 4))]
            shown = [x for k, x in enumerate(frame) if rng.random() < 0.9 - 0.2 * k]
            rows.append((len(rows), host, "\n".join([*shown, *own]), 0))
    rows += [(1000, "a", None, 0), (1001, "a", "", 0), (1002, "a", " \n ", 0), *rows[:3]]
    df = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"n_chars": "host"})
    for ratio in (0.02, 0.3):
        got = {r["host"]: set(r["lines"]) for r in lines.folded_boilerplate(df, ratio).collect()}
        want = folded(rows, ratio, lines.LEAST_PAGES)
        texts = spark.createDataFrame([(x,) for held in want.values() for x in held], "x string")
        number = {r["x"]: r["h"] for r in texts.selectExpr("x", "xxhash64(x) h").collect()}
        assert got == {("" if h is None else "=" + h): {number[x] for x in held} for h, held in want.items()}
        assert got


def test_no_rows_and_no_text(spark):
    none = spark.createDataFrame([], DOCS)
    assert lines.folded_boilerplate(none).count() == 0
    assert lines.drop_boilerplate(none, fold_copies=True).count() == 0
    blank = spark.createDataFrame([(i, None, t, 0) for i, t in enumerate([None, "", None, " ", "x"] * 5)], DOCS)
    got = lines.drop_boilerplate(blank, fold_copies=True).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [None, "", None, " ", "x"] * 5
