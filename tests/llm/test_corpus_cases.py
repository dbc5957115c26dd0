"""Hand-made rows for every corpus operator: nulls, empty and long texts, ties, repeats, no rows,
clashing column names, and small brute-force versions of the parts that SQL cannot express."""

import collections
import hashlib
import itertools
import math

import numpy as np
import pytest

import corpus_pipeline
from signalbook.llm import dialogue, exact, fingerprints, html_text, lines, mixing, pieces, quality, secrets, simhash
from signalbook.llm.common import free_name
from signalbook.llm.components import components
from signalbook.session import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, fp string, score string, copies string"
EXTRA = ("x", None, "y", "z", "w")
ROWS = [
    (1, "one two three", "en", "a"),
    (1, "one two three", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (None, "one two three", "en", "b"),
    (4, "ONE two\nthree", "en", "b"),
    (5, "word " * 30_000, "en", "b"),
    (6, "\n \t\n", "en", "c"),
    (7, "É one 😀 ▁ two", "fr", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, len(r[1]) if r[1] is not None else None, 1, *EXTRA[:4]) for r in ROWS]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, None) for i in range(1, 8)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_empty_tables(spark, none, labels):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    pages = spark.createDataFrame([], "page_id long, html string")
    frames = [
        mixing.mix(none), mixing.mixed_documents(none), pieces.encode(none), lines.drop_boilerplate(none), quality.score_and_decide(none, labels),
        quality.keep_good(none, labels), dialogue.rotate(turns), fingerprints.edited_fingerprints(none, samples=4), html_text.extract(pages),
        simhash.near_groups(none), simhash.drop_near(none), exact.exact_groups(none), exact.drop_exact(none),
        secrets.scan(none.select("doc_id", "text"), scratch_path(spark, "ledger")),
    ]
    assert [frame.count() for frame in frames] == [0] * len(frames)


def test_mixing(docs, spark):
    rows = [r.asDict() for r in mixing.mix(docs).collect()]
    assert len(rows) == len(ROWS)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["doc_id"]: r["size"] for r in rows}[5] == 30_000
    assert [r["copies"] for r in rows if r["size"] == 0] == [1, 1, 1]
    assert rows and sorted(map(str, rows)) == sorted(map(str, (r.asDict() for r in mixing.mix(docs).collect())))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in rows)


def test_mixing_comes_near_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE_ROWS", 7)  # many pieces
    sizes = {"a": [5] * 400, "b": [3, 8, 1] * 30, "c": [40, 2], None: [10] * 20}
    rows = [(i, " ".join("w" * n), s) for i, (s, n) in enumerate((s, n) for s, all_ in sizes.items() for n in all_)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    total = collections.Counter()
    for r in mixed:
        total[r["source"]] += r["taken"]
    target = {r["source"]: r["target"] for r in mixed}
    for source, all_ in sizes.items():
        assert target[source] <= 2 * sum(all_)
        assert abs(total[source] - target[source]) <= max(all_)
    budget = 1.5 * sum(map(sum, sizes.values()))
    assert math.isclose(sum(target.values()), budget) and sum(total.values()) <= budget
    named = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights={"a": 1.0, "c": 9.0}).collect()
    assert {r["source"]: r["target"] for r in named}["c"] == 84.0


def brute_segmentations(text, voc, names):
    if not text:
        yield ()
        return
    for n in range(1, len(text) + 1):
        if text[:n] in names:
            for rest in brute_segmentations(text[n:], voc, names):
                yield (names[text[:n]], *rest)


def test_pieces_follow_the_lattice_distribution():
    import sentencepiece

    voc = pieces.load()
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    names = {model.id_to_piece(i): i for i in range(259, model.get_piece_size())}
    weight = {s: math.exp(sum(voc.log_weight[i] for i in s)) for s in brute_segmentations("▁tione", voc, names)}
    lat = pieces.lattice([" tione"], voc)
    assert math.isclose(lat.reach[lat.final[0]], math.log(sum(weight.values())))
    n = 40_000
    drawn = collections.Counter(tuple(ids.tolist()) for ids in pieces.encode_batch(["tione"] * n, np.arange(n, dtype=np.int64) * 7919, voc))
    assert set(drawn) <= set(weight)
    for s, w in weight.items():
        p = w / sum(weight.values())
        assert abs(drawn[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9


def test_pieces(docs, spark):
    encoded = pieces.encode(docs)
    rows = encoded.collect()
    assert len(rows) == len(ROWS) and all(r["lossless"] for r in rows)
    assert all(r["pieces_sha256"] == hashlib.sha256(np.array(r["pieces"], "<i4").tobytes()).hexdigest() for r in rows)
    back = collections.Counter((r["doc_id"], r["text"]) for r in pieces.decoded(encoded).collect())
    assert back == collections.Counter((r[0], r[1] or "") for r in ROWS)
    voc = pieces.load()
    texts = ["  two  blanks ", "\x00\x7f\n\r\n", "▁▁ ▁", "\U0010ffff퟿", " ", "a" * 5000, "日本語 text"]
    together = pieces.encode_batch(texts, np.arange(len(texts), dtype=np.int64), voc)
    assert [pieces.decode(ids.tolist(), voc) for ids in together] == texts
    alone = [pieces.encode_batch([t], np.array([i], np.int64), voc)[0].tolist() for i, t in enumerate(texts)]
    assert alone == [ids.tolist() for ids in together]  # a row's sample does not depend on its batch


def test_lines(spark, docs):
    rows = [(i, f"menu\nown {i}\n\n menu ", "h") for i in range(8)] + [(8, "menu", "h"), (9, "menu\nx", None), (10, None, "h")]
    pages = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = {r["doc_id"]: r for r in lines.drop_boilerplate(pages, counts=("full", "gone")).collect()}
    assert plain[3]["text"] == "own 3\n" and (plain[3]["full"], plain[3]["gone"]) == (3, 2)
    assert plain[8]["text"] == "" and plain[9]["text"] == "menu\nx" and plain[10]["text"] is None
    spared = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(pages, spare_copies=True).collect()}
    assert spared[8] == "menu" and spared[3] == "own 3\n"
    kept = lines.drop_boilerplate(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))


def test_quality(docs, labels, spark):
    rows = quality.score_and_decide(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.keep_good(docs, labels, threshold=0.0).columns == docs.columns
    assert sorted(map(str, quality.keep_good(docs, labels, threshold=0.0).collect())) == sorted(map(str, docs.collect()))
    assert quality.train(docs, labels.limit(0)) == 0.5
    texts = [r[1] or "" for r in ROWS] + ["Ünï cödé! words. " * 200, "a"]
    x, counts = quality.encode(texts)
    for i, text in enumerate(texts):
        alone, n = quality.encode([text])
        at = counts[:i].sum()
        assert n[0] == counts[i] and np.allclose(alone, x[at : at + counts[i]])


def test_attention_finds_the_telling_passage():
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 12, 300)
    x = rng.normal(size=(counts.sum(), quality.FEATURES))
    label = rng.integers(0, 2, 300).astype(float)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    telling = starts + rng.integers(0, counts)
    x[telling, 0] += np.where(label == 1, 0, 6)
    model = quality.fit(x, counts, label)
    s = quality.attend(model, x, counts)
    assert np.mean((s["score"] > 0.5) == label) > 0.95
    bad = np.flatnonzero((label == 0) & (counts > 3))
    assert np.mean([s["a"][telling[i]] == s["a"][starts[i] : starts[i] + counts[i]].max() for i in bad]) > 0.8


def test_gradients_match_finite_differences(monkeypatch):
    rng = np.random.default_rng(5)
    x, counts, label = rng.normal(size=(9, quality.FEATURES)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])
    monkeypatch.setattr(quality, "ROUNDS", 300)
    s = quality.attend(quality.fit(x, counts, label), x, counts)
    assert np.allclose(s["score"], label, atol=0.1)


def test_chat(spark):
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "who"),
        (None, 0, "ann", "alone"), (2, 0, "system", "x"), (1, None, "ann", "late"),
    ]
    frame = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, start int")
    rows = dialogue.rotate(frame).collect()
    assert {(r["conv_id"], r["perspective"]) for r in rows} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    whole = {(r["conv_id"], r["perspective"]): r for r in dialogue.assembled(dialogue.rotate(frame)).collect()}
    one = whole[(1, "ann")]
    assert one["text"] == (
        "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user:bob|>\n<|end|>\n<|user:bob|>\n<|end|>\n"
        "<|user:unknown|>\nwho<|end|>\n<|assistant|>\nlate<|end|>\n"
    )
    assert [one["text"][m["start"] : m["end"]] for m in one["masks"]] == ["hi<|end|>\n", "late<|end|>\n"]
    assert sorted(r["place"] for r in rows if r["perspective"] == "bob") == list(range(6))


def test_gamma_quantiles():
    for p in (1e-7, 0.01, 0.5, 0.99):
        x = fingerprints.gamma_quantile(p)
        assert math.isclose(-math.expm1(-x) - x * math.exp(-x), p, rel_tol=1e-6)


def test_sampling_follows_weights(spark):
    texts = [(0, "a a a b c"), (1, "a b b c c d"), (2, ""), (3, "a a a b c"), (4, None)]
    rows = spark.createDataFrame(texts, "k long, text string")
    sig = {r["k"]: r["signature"] for r in fingerprints.signatures(rows, ["k"], samples=200).collect()}
    assert sig[0] == sig[3] and sig[2] == sig[4] == [0] * 200
    same = np.mean(np.array(sig[0]) == np.array(sig[1]))
    assert abs(same - 3 / 8) < 4 * math.sqrt(3 / 8 * 5 / 8 / 200)


def test_edited_fingerprints(docs):
    rows = fingerprints.edited_fingerprints(docs, samples=8).collect()
    assert len(rows) == len(ROWS)
    ordered = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in ROWS})
    follow = dict(zip(ordered, ordered[1:] + ordered[:1]))
    want = collections.Counter()
    for r in ROWS:
        text, other = r[1] or "", follow[(r[0] is not None, r[0] or 0, r[1] or "")][2]
        edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        want[(r[0], len(text), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain &lt;b&gt; 1 < 2", "plain <b> 1 < 2"),
        ("<p>a<p>b<br>c", "a\n\nb\nc"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>z", "- a\n- b\n  3. x\n  4. y\n\nz"),
        ("<table><tr><th>N<th>Value<tr><td>longer<td>1</table>", "N      | Value\nlonger | 1"),
        ("<div style='display:none'>no</div><p hidden>no<p>yes<script>if(a<b)</script>", "yes"),
        ("<title>t</title><body>b<!-- <p>c --><textarea>d</textarea>", "bd"),
        ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
        ("<td>loose<b>bold</i></td>", "loosebold"),
        ("x<script>never ends", "x"),
        ("<dl><dt>T<dd>D</dl>", "T\n    D"),
    ],
)
def test_page_text(page, text):
    assert html_text.text_of_page(page) == text


def test_deep_and_long_pages():
    assert html_text.text_of_page("<div>" * 5000 + "x") == "x"
    assert html_text.text_of_page("<table><tr><td>" * 300 + "x").strip() == "x"
    assert html_text.text_of_page("<" * 20000 + "x").endswith("x")


def test_byte_sets_cover_all_choices():
    sets = simhash.byte_sets()
    assert len(sets) == 20
    for four in itertools.combinations(range(8), 4):
        assert any(set(s) <= set(four) for s in sets)


def brute_groups(values, bits):
    groups = {}
    left = set(range(len(values)))
    while left:
        todo, group = [min(left)], set()
        while todo:
            i = todo.pop()
            if i in left:
                left.discard(i)
                group.add(i)
                todo += [int(j) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= bits) if j in left]
        groups |= {i: min(values[j] for j in group) for i in group}
    return groups


def test_links_join_every_group_even_in_long_lists(spark):
    rng = np.random.default_rng(1)
    values = set(rng.integers(0, 2**64, 200, dtype=np.uint64).tolist())
    for centre in rng.integers(0, 2**64, 3, dtype=np.uint64).tolist():
        for _ in range(150):  # dense groups, far longer than a list may be
            values.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 8), replace=False)))
    values = np.array(sorted(values), np.uint64)
    signed = values.view(np.int64)
    frame = spark.createDataFrame([(int(v),) for v in signed], "fp long")
    found = components(simhash.links(frame, list_rows=16))
    root = {r["node"]: r["root"] for r in found.collect()}
    group = brute_groups(values, 4)
    by_root = collections.defaultdict(set)
    for i, v in enumerate(signed.tolist()):
        by_root[root.get(v, v)].add(int(group[i]))
    assert all(len(g) == 1 for g in by_root.values())
    assert len(by_root) == len(set(map(int, group.values())))


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}


def test_near_groups(docs):
    rows = simhash.near_groups(docs).collect()
    assert len(rows) == len(ROWS)
    of = collections.defaultdict(set)
    for r in rows:
        of[r["doc_id"]].add(r["component_id"])
    assert of[1] == of[4] == of[None] == {1} and of[2] == of[3] == of[6] == {2}
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 7]


def test_exact_groups(docs, spark):
    for settings in ({}, {"key_bits": 2, "bits": 2, "capacity": 1}):  # four keys: chains of different texts
        rows = exact.exact_groups(docs, **settings).collect()
        assert len(rows) == len(ROWS)
        groups = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"]) for r in rows}
        empty = hashlib.sha256(b"").hexdigest()
        assert groups[(2, empty)] == groups[(3, empty)] == (3, 2)
        three = hashlib.sha256(b"one two three").hexdigest()
        assert groups[(1, three)] == groups[(None, three)] == (1, 3)
        assert groups[(4, hashlib.sha256(b"one two\nthree").hexdigest())] == (4, 1)
        assert sum(r["kept"] for r in rows) == len({r["text_sha256"] for r in rows})
    kept = exact.drop_exact(docs)
    assert kept.columns == docs.columns and kept.count() == len({(r[1] or "").lower() for r in ROWS})
    assert free_name(docs, "KEPT") == "KEPT_"


def test_directory_splits_overfull_buckets(spark):
    cells = [(i % 4,) for i in range(40)] + [(12,)] * 50 + [(15,)]
    buckets = {r["cell"]: (r["depth"], r["bucket"]) for r in exact.directory(spark.createDataFrame(cells, "cell long"), 45, 4).collect()}
    assert {buckets[c] for c in range(4)} == {(1, 0)}
    assert buckets[12] == (4, 12) and buckets[15] == (3, 14)


def test_ledger_scans_only_what_is_new(spark):
    ledger = scratch_path(spark, "ledger")
    frame = lambda rows: spark.createDataFrame(rows, "path string, text string, spans int")
    first = frame([("a", "token: abcdefgh1", 0), ("b", "token: abcdefgh1", 0), ("c", None, 0), ("d", "AKIA" + "A" * 12, 0)])
    got = {r["path"]: r["spans"] for r in secrets.scan(first, ledger, secrets.BASE_RULES).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got["b"]] == [("assign", 0, 16)] == [(s["kind"], s["start"], s["end"]) for s in got["a"]]
    assert got["c"] == [] and got["d"][0]["kind"] == "access"
    assert spark.read.parquet(ledger).count() == 3
    second = first.union(frame([("e", "0123456789abcdef" * 2, 0)]))
    secrets.scan(second, ledger, secrets.BASE_RULES).count()
    assert spark.read.parquet(ledger).count() == 4
    secrets.scan(second, ledger, secrets.BASE_RULES).count()
    assert spark.read.parquet(ledger).count() == 4
    newer = (secrets.BASE_RULES[0]._replace(version=2, least=12), *secrets.BASE_RULES[1:])
    got = {r["path"]: r["spans"] for r in secrets.scan(second, ledger, newer).collect()}
    assert got["a"] == [] and got["e"][0]["kind"] == "hex"
    again = spark.read.parquet(ledger).where("size(rules) = 1 and rules[0] = 'assign@2'")
    assert again.count() == 4


@pytest.mark.parametrize(
    "text, spans",
    [
        ("Password = \"hunter2hunter2\"", [("assign", 0, 26)]),
        ("token=secret: longvalue123", []),  # the failing match uses up 'secret'
        ("toKen=abcdefgh9", []),  # only ASCII letters in either case
        ("api-key=abcdefgh apikey=abcdefgh API_KEY: abcdefgh", [("assign", 17, 32), ("assign", 33, 50)]),
        ("xAKIA" + "Z" * 11, []),
        ("😀" + "f" * 33 + "g", [("hex", 1, 34)]),
        ("F" * 40, []),
    ],
)
def test_base_rules(text, spans):
    found = secrets.find_secrets(text, secrets.BASE_RULES)
    assert [(kind, start, end) for start, end, kind in found] == spans


def test_pipeline_stages(spark, docs, tmp_path):
    spark.createDataFrame([(i, 1, 0) for i in range(1, 8)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == kept.count() and out.where("not lossless").count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES][2] == "SimHash near-dedup"


def test_quality_fits_on_whole_documents(spark, monkeypatch):
    # Long documents are never cut for fitting; the bound stops the choice between documents.
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda x, counts, label: seen.update(counts=list(counts)) or {})
    docs = spark.createDataFrame([(i, "some word " * (32 * (i % 7 + 1) * 20)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    quality.train(docs, labels)
    full = seen["counts"]
    assert sorted(set(full)) == [20 * k for k in range(1, 8)]
    quality.train(docs, labels, passages=300)
    some = seen["counts"]
    assert some == full[: len(some)] and sum(some) >= 300 > sum(some[:-1])
