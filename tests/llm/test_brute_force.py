"""The training-data operators against plain versions of their rules, on any frame, with clashing columns, and stage by stage."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import AWKWARD, PIECES, SCHEMA, WORDS, awkward, brute_components, empty, fill, moved, norm, rows_of  # noqa: F401

from fieldbook.llm import common, exact_dedup, langid, licenses, media, mixing, near_dedup, quality, sentencepieces, token_counts, toxicity



@pytest.fixture(scope="module")
def filed(spark, tmp_path_factory):
    """A frame of Parquet files, as operators meet it: some rows equal, some alike."""
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(4, 60))) for _ in range(30)]
    texts = base + [t + " more" for t in base[:12]] + base[:6] + [None, "", "one"]
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(rows_of(texts, sources=["a", "b", None] * 17), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def frames_of(spark, filed):
    twice = F.explode(F.array(F.lit(1), F.lit(2)))
    return {
        "plain": filed,
        "filtered": filed.where("doc_id % 2 = 0 AND (text IS NULL OR text LIKE '%w%')").select("doc_id", "text", "source"),
        "exploded": filed.withColumn("twice", twice),
        "joined": filed.join(spark.range(2).withColumnRenamed("id", "other")),
        "united": filed.union(filed),
        "limited": filed.orderBy("doc_id").limit(20),
    }


@pytest.mark.parametrize("kind", ["plain", "filtered", "exploded", "joined", "united", "limited"])
def test_any_frame_has_unique_locators(spark, filed, kind):
    frame = frames_of(spark, filed)[kind]
    located, name = common.located(frame)
    assert located.count() == frame.count() == located.select(name).distinct().count()
    rows = frame.select("doc_id", "text").collect()
    texts = {norm(r.text) for r in rows}
    assert exact_dedup.exact_dedup(frame).where("kept").count() == exact_dedup.drop_copies(frame).count() == len(texts)
    assert mixing.mix(frame, block=8).count() == mixing.copies(frame, block=8).agg(F.sum("copies")).first()[0]


def test_near_dedup_of_an_exploded_frame(spark, filed):
    frame = filed.withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2))))
    want = brute_components([(r.doc_id, r.text) for r in filed.collect()], 5, 80, 100)
    got = near_dedup.near_duplicates(frame)
    assert Counter((r.doc_id, r.component_id) for r in got.collect()) == Counter({(i, c): 2 for i, (_, c) in want.items()})
    roots = {c for i, (n, c) in want.items() if n}
    assert near_dedup.drop_near_copies(frame).count() == len(roots) + 2 * sum(not n for n, _ in want.values())


def test_a_path_given_twice(spark, filed):
    path = filed.inputFiles()[0]
    twice = spark.read.parquet(path, path)
    located, name = common.located(twice)
    assert located.select(name).distinct().count() == twice.count() == 2 * spark.read.parquet(path).count()


def test_hot_keys_join_as_others_do(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 4)
    rows = spark.createDataFrame([(i % 3 if i < 60 else 100 + i % 9, i) for i in range(90)], "key long, node long")
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    values = counts.where("key <> 1").select("key", (F.col("key") * 10).alias("v"))
    want = {(r.key, r.node): r.key * 10 for r in rows.collect() if r.key != 1}
    assert {(r.key, r.node): r.v for r in common.salted_join(rows, "key", "node", values, counts).collect()} == want
    assert common.salted_join(rows, "key", "node", values, counts, "left").where("v IS NULL").count() == 20
    led = common.with_leaders(rows, "key", "node", F.struct("node")).collect()
    assert len(led) == 90 and all(r.leader.node == min(x.node for x in led if x.key == r.key) for r in led)


def test_repeated_ids_fill_many_blocks(spark):
    rows = spark.range(1000).select(F.lit("a").alias("source"), F.lit(7).cast("long").alias("key"), (F.col("id") % 9 + 1).alias("size"), F.lit(0.5).alias("p"), F.struct(F.lit("f").alias("file"), F.col("id").alias("row")).alias("locator"))
    made = mixing._reduce(rows, 17, 0, 16).select((F.size("out") + F.col("held").isNotNull().cast("int")).alias("n")).collect()
    assert sum(r.n for r in made) == 1000 and max(r.n for r in made) <= 4 * 16


def test_mixing_targets_by_brute_force(spark):
    """Caps and reshared excess, for sources of many sizes, one of them empty."""
    for sizes in ({"a": 100, "b": 10, "c": 3, None: 50}, {"x": 5}, {"a": 1, "b": 1000, "c": 0, "d": 7}):
        frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
        assert got == pytest.approx(fill(sizes))


def test_nystroem_ridge_by_brute_force(spark):
    """The folded model of a frame against kernel values, features and regression written out."""
    rng = random.Random(1)
    words = {"en": "the and of with this that house".split(), "de": "der die und mit das nicht haus".split(), "fr": "le la et avec ce pas maison".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(8)), lang) for i, lang in enumerate(list(words) * 20)]
    docs = spark.createDataFrame([*rows, (90, "½ ²", "en"), (91, None, "de"), (92, "the", None)], "doc_id long, text string, lang string")
    model = langid.train(docs, landmarks=5, ridge=0.01)
    sample, n = langid._sampled(docs, langid.FIT_ROWS, langid.MOST_ROWS, 2)
    learned = sorted(sample.collect(), key=lambda r: (r.order, r.lang))
    assert n == 3 and len(learned) == 60
    grams = [set(r.slots) for r in learned]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    marks = [g for g, r in zip(grams, learned, strict=True) if r.order <= 5]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    keep = values > 1e-6 * values.max()
    features = lambda g: (np.array([[kernel(x, m) for m in marks] for x in g]) @ vectors[:, keep]) / np.sqrt(values[keep])
    z, y = features(grams), np.where(np.array([r.lang for r in learned])[:, None] == np.array(["de", "en", "fr"])[None], 1.0, -1.0)
    w = np.full((60, 1), 1 / 20)
    centre, middle = (z * w).sum(0) / w.sum(), (y * w).sum(0) / w.sum()
    beta = np.linalg.solve(((z - centre) * w).T @ (z - centre) + 0.01 * np.eye(z.shape[1]), ((z - centre) * w).T @ (y - middle))
    asked = ["the house with that", "die maus und das haus", "avec la maison", "zzz"]
    want = (features([set(langid._slots(t).tolist()) for t in asked]) - centre) @ beta + middle
    assert langid.presence(asked) @ model.weights + model.offset == pytest.approx(want, abs=1e-4)
    assert model.predict(["½ ² ①", "12", "", None])[0] == ["und"] * 4


def test_every_language_is_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(3 * k + j, (letters[k % 26] + letters[k // 26] * 2 + " ") * 4, f"l{k:03d}") for k in range(210) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    told = langid.identify(docs, model).collect()
    assert len(model.languages) == 210 and np.mean([r.lang == r.lang_pred for r in told]) > 0.95


def naive_weigh(model, text):
    """Every term at every place, by regular expressions."""
    text, total = toxicity.fold(text), 0.0
    by_term = {}
    for term, weight in model.weights.items():
        plain = term.rstrip("*")
        old = by_term.get(plain, (False, 0.0))
        by_term[plain] = (old[0] or term.endswith("*"), max(old[1], weight))
    alone = lambda p, stem: re.finditer(rf"(?<![^\W\d_])(?={re.escape(p)}{'' if stem else r's?(?![^\W\d_])'})", text)
    safe = [(m.start(), m.start() + len(p)) for p in model.exceptions for m in alone(p, False)]
    for plain, (stem, weight) in by_term.items():
        if plain not in model.exceptions:
            total += sum(weight for m in alone(plain, stem) if not any(a <= m.start() and m.start() + len(plain) <= b for a, b in safe))
    return math.log1p(total / (1 + math.log1p(len(text) / 2000)))


def test_toxicity_weights_by_brute_force():
    rng = random.Random(3)
    model = toxicity.Model({"bad": 1.0, "baddy": 2.0, "uriy*": 1.5, "ab": 0.5}, ("bad idea", "a bad idea"))
    parts = ["bad", "bads", "BADDY", "ugly", "uglyish", "idea", "a", "ab", " ", " ", "4b", "b4d", "455", "xbad", ".", "bad idea"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(30)) for _ in range(200)]
    model = toxicity.Model({toxicity.fold(k): v for k, v in model.weights.items()}, tuple(toxicity.fold(p) for p in model.exceptions))
    assert model.measure(texts) == pytest.approx([naive_weigh(model, t) for t in texts])


@pytest.mark.parametrize(("given", "wanted"), [("room 455", "room 455"), ("4ss", "ass"), ("h3110", "heiio"), ("$5 and 3€5", "$5 and 3€5"), ("a$$et", "asset"), ("lo​ser", "ioser"), ("ＬＯＳＥＲ", "ioser"), ("𝐥𝐨𝐬𝐞𝐫", "ioser"), ("lòsér", "ioser"), (None, "")])
def test_fold(given, wanted):
    assert toxicity.fold(given) == wanted


def test_toxicity_learns_terms_and_exceptions(spark):
    """Long and short words are candidates, and what clean rows hold beside a lexicon word is an exception."""
    long = "x" * 45
    texts = [(f"you are {long} number{i} today", 1) for i in range(12)] + [(f"qz is what you are n{i}", 1) for i in range(12)] + [(f"the blob of text{i} and more words{i}", 0) for i in range(40)]
    texts += [(f"slime you are again{i}", 1) for i in range(40)] + [(f"slime mould grows here{i} slowly", 0) for i in range(4)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, label int")
    model = toxicity.train(docs, labels)
    hit = model.measure([f"{long} you", "qz you", "slime you", "slime mould", "the blob of text"]) > 0
    assert hit.tolist() == [True, True, True, False, False] and "siime mouid" in model.exceptions


def test_statistics_by_brute_force():
    texts = [t for t in AWKWARD if t is None or len(t) < 1000] + ["Hello, World! 123\nfoo|bar baz baz $$ end$", "é ü ABC def.\tx\x0by", "#hash tag# a a a " + "y" * 30]
    got = quality.statistics(texts)
    for row, text in zip(got, texts, strict=True):
        raw = (text or "").encode()
        words = raw.split()
        m, n, tops = len(words), len(raw), Counter(words)
        of = lambda chars: sum(raw.count(bytes([c])) for c in chars.encode())  # noqa: E731, B023
        space, upper, lower, foreign = of(" \t\n\x0b\x0c\r"), sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw), sum(c > 127 for c in raw)
        symbols = "!#$%&*+/<=>@[\\]^_`{}~"
        ends = sum(w[-1:] in [s.encode() for s in symbols] for w in words)
        want = [
            math.log(m + 20), math.log((n - space + 100) / (m + 20)), math.log(0.01 + upper / (upper + lower + foreign + 100)), math.log(0.001 + of(symbols) / (n + 100)), math.log(0.01 + of(".,;:?'\"()-") / (n + 100)), math.log(0.01 + of("0123456789") / (n + 100)), math.log(0.001 + of("|") / (m + 20)),
            math.log(0.01 + sum(a == b for a, b in zip(words, words[1:], strict=False)) / (m + 20)), math.log((len(tops) + 20) / (m + 20)), math.log((max(tops.values(), default=0) + 1) / (m + 20)), math.log(0.01 + ends / (m + 20)), math.log(0.001 + sum(c for w, c in tops.items() if len(w) > 24) / (m + 20)), math.log(n / (raw.count(b"\n") + 1) + 100), math.log(0.01 + foreign / (n + 100)),
        ]
        assert row == pytest.approx(want), text


def test_shrunken_covariances_by_brute_force():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 3)) * [1, 2, 5], np.repeat([0, 1], [45, 15])
    model = quality.fit(x, y, 0.3, 0.2)
    z = (x - x.mean(0)) / (x.std(0) + 1e-9)
    density = []
    for k in (0, 1):
        own, d = z[y == k], 3
        shape = 0.7 * np.cov(own, rowvar=False, bias=True) + 0.3 * np.cov(z, rowvar=False, bias=True)
        shape = 0.8 * shape + 0.2 * np.trace(shape) / d * np.eye(d)
        diff = z - own.mean(0)
        density.append(np.log((len(own) + 0.5) / 61) - 0.5 * np.log(np.linalg.det(shape)) - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(shape), diff))
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(density[0] - density[1])), abs=1e-9)


def test_hamming_tables_by_brute_force():
    """All pairs within the bits that share a key, and every pair that differs in few."""
    rng = np.random.default_rng(7)
    stored = rng.integers(0, 1 << 32, (300, 8)).astype(np.uint32)
    asked = stored[rng.integers(0, 300, 120)].copy()
    for row in asked:
        for bit in rng.choice(256, rng.integers(0, 50), replace=False):
            row[bit // 32] ^= np.uint32(1 << (31 - bit % 32))
    held = media._pieces(stored)
    words = [np.ascontiguousarray(w).view(np.uint64) for w in (asked, stored)]
    a, b = media._alike(words[0], media._pieces(asked), words[1], held, [np.argsort(own, kind="stable") for own in held])
    assert len(a) == len(set(zip(a.tolist(), b.tolist(), strict=True)))
    differ = np.bitwise_count(asked[:, None] ^ stored[None]).sum(-1)
    share = (media._pieces(asked)[:, :, None] == media._pieces(stored)[:, None, :]).any(0)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero((differ <= media.MOST_BITS) & share)), strict=True))
    assert share[differ <= 9].all()


def described(pictures, up=0):
    """The corners of pictures of one size, and their pictures' numbers."""
    image, *values = media.describe(np.stack(pictures).astype(np.float32), up)
    order = np.argsort(image, kind="stable")
    found = np.zeros(len(order), media._CORNER)
    for field, own in zip(media._CORNER.names, values, strict=True):
        found[field] = own[order]
    return found, image[order]


def test_media_couples_by_brute_force():
    """Each couple once, all within reach, and some for corners that are far from others."""
    rng = np.random.default_rng(12)
    dots = np.zeros((300, 300))
    for y, x in ((40, 40), (40, 250), (250, 60), (240, 240), (150, 130)):
        dots[y : y + 4, x : x + 4] = 200
    for pictures in (list(media.paint(rng.normal(size=(4, 64)))), [media.paint(rng.normal(size=(1, 400)), 300)[0], dots]):
        corners, image = described(pictures, 1)
        i, j = media._couples(corners, image)
        got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        assert len(got) == len(i)
        scale, place = corners["scale"], corners["x"] + 1j * corners["y"].astype(float)
        a, b = np.triu_indices(len(corners), 1)
        apart = abs(place[a] - place[b]) * media.STEP ** np.minimum(scale[a], scale[b]).astype(float)
        may = (image[a] == image[b]) & (abs(scale[a] - scale[b]) <= 1)
        near = {(x, y) for x, y in zip(a[may & (apart < media.REACH)].tolist(), b[may & (apart < media.REACH)].tolist(), strict=True)}
        assert near <= got <= {(x, y) for x, y in zip(a[may].tolist(), b[may].tolist(), strict=True)}
        degree = np.bincount([x for both in got for x in both], minlength=len(corners))
        most = np.bincount(np.concatenate([a[may], b[may]]), minlength=len(corners))
        assert (degree >= np.minimum(most, media.FEW)).all()


def test_media_pairs_without_a_common_couple_are_not_compared(monkeypatch):
    rng = np.random.default_rng(13)
    pictures = media.paint(rng.normal(size=(200, 64)))
    m, other = described(pictures)
    q, image = described([media.edit(pictures[i], 0) for i in range(40)], 1)
    monkeypatch.setattr(media, "TABLE", 10_000)  # several tables
    pairs = media._in_common(q, image, m, other, media._couples(m, other))
    assert {i * 200 + i for i in range(40)} <= set(pairs.tolist()) and (np.diff(pairs) > 0).all()
    assert len(pairs) < 0.1 * 40 * 200
    ours, theirs = pairs // 200, pairs % 200
    ends, m_ends = np.searchsorted(image, np.arange(41)), np.searchsorted(other, np.arange(201))
    one, two = media._compared(q), media._compared(m)
    a, b = media._alike(one[0], one[2], two[0], two[2], [np.argsort(keys, kind="stable") for keys in two[2]])
    number = {int(p): k for k, p in enumerate(pairs)}
    want = {(number[p], x, y) for p, x, y in zip((image[a] * 200 + other[b]).tolist(), a.tolist(), b.tolist(), strict=True) if p in number}
    for held in (media.HELD, 700):  # large pairs go through the tables
        monkeypatch.setattr(media, "HELD", held)
        got = [c.tolist() for c in media._matches(one, ends[ours], ends[ours + 1], two, m_ends[theirs], m_ends[theirs + 1])]
        assert len(got[0]) == len(want) and set(zip(*got, strict=True)) == want


def test_media_index_finds_what_all_pairs_give(spark):
    rng = np.random.default_rng(14)
    pictures = media.paint(rng.normal(size=(150, 64)))
    frame = lambda rows: spark.createDataFrame(rows, "id long, media binary")
    stored = frame([(i, media.pgm(p)) for i, p in enumerate(pictures)])
    edits = [lambda p: p[12:52, 9:49], lambda p: media.edit(p, 0) + rng.normal(0, 6, (52, 54)), lambda p: np.rot90(p)[3:60, 5:61]]
    asked = frame([(1000 * k + i, media.pgm(np.rint(np.clip(edit(pictures[i]), 0, 255)).astype(np.uint8))) for k, edit in enumerate(edits) for i in range(15)])
    got, want = ({(r.query, r.match) for r in media.find_copies(asked, stored, exact=exact).collect()} for exact in (False, True))
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 35


def test_media_classes_stand_for_their_members(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(12, 64))
    near = np.concatenate([base[:2] + rng.normal(0, 0.07, (2, 64)) for _ in range(15)])
    vectors = np.concatenate([base, near])
    pictures = media.paint(vectors.astype(np.float32))
    stored = [(i, media.pgm(p)) for i, p in enumerate(pictures)] + [(90, media.pgm(pictures[5])), (91, None)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, media binary")
    grouped = media.group(frame(stored))
    of = {r.id: r["class"] for r in media.classes(frame(stored), grouped=grouped).collect()}
    assert of == {i: i if i < 12 else (i - 12) % 2 for i in range(len(vectors))} | {90: 5}
    asked = [(100 + i, media.pgm(media.edit(pictures[i], 50 * i))) for i in range(len(vectors))]
    got = {(r.query, r.match) for r in media.find_copies(frame(asked), frame(stored), grouped=grouped).collect()}
    want = {(100 + i, of[i]) for i in range(len(vectors))}
    assert len(got & want) >= 0.9 * len(want) and not got - want


def test_clashing_columns_are_kept(spark):
    names = "doc_id long, text string, lang string, source string, score double, lang_pred string, n_words int, base int, notices int, evidence int, n_tokens int, ids array<int>, decoded string, size int, copies int, locator int, key int, node int, n int, Leader int, image int"
    docs = spark.createDataFrame([(i, t, "en", "a", 1.0, "x", *range(4), 7, [1], "d", *range(8)) for i, t in enumerate(["some text here", "some text here", None, "mit license"])], names)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("label"))
    model = langid.train(docs.select("doc_id", "text", "lang"))
    texts = docs.select("doc_id", "text")
    made = {
        "identify": (langid.identify(docs, model), 2),
        "licenses": (licenses.scan_licenses(docs), 4),
        "tokens": (token_counts.count_tokens(docs, WORDS), 1),
        "encode": (sentencepieces.encode(docs, PIECES), 1),
        "decode": (sentencepieces.decode(docs, PIECES), 1),
        "quality": (quality.score(docs, quality.train(texts, labels)), 1),
        "toxicity": (toxicity.score(docs, toxicity.train(texts, labels)), 1),
    }
    before = sorted(docs.collect())
    for name, (frame, n) in made.items():
        assert len(frame.columns) == len(docs.columns) + n and len({c.lower() for c in frame.columns}) == len(frame.columns), name
        assert sorted(frame.select(*docs.columns).collect()) == before, name
    for kept in (exact_dedup.drop_copies(docs), near_dedup.drop_near_copies(docs), mixing.mix(docs), quality.drop_rejected(docs, texts, labels)):
        assert kept.columns == docs.columns and kept.count() >= 0


def test_empty_tables_everywhere(spark, empty):  # noqa: F811
    assert token_counts.count_tokens(empty, WORDS).count() == 0
    coded = sentencepieces.encode(empty, PIECES, into="pieces")
    assert coded.count() == 0 and sentencepieces.decode(coded, PIECES, "pieces").count() == 0
    assert exact_dedup.drop_copies(empty).count() == near_dedup.drop_near_copies(empty).count() == 0


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, i % 2, 0) for i in range(14)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def test_pipeline_stages_by_brute_force(spark, awkward, labelled):  # noqa: F811
    """Each stage on awkward rows (nulls, empty and very long texts, repeats, clashing names) against its rule."""
    import corpus_pipeline
    import sentencepiece

    stages = dict(corpus_pipeline.STAGES)
    docs = awkward.unionByName(awkward.where("doc_id = 6"))
    rows = docs.collect()
    labels = quality.quality_labels(spark.read.parquet(f"{labelled}/labels.parquet"))
    model = quality.train(docs.select("doc_id", "text"), labels)
    kept = model.score(quality.statistics([r.text for r in rows])) >= 0.5
    got = stages["quality classifier"](spark, docs, labelled)
    assert got.columns == docs.columns and Counter(got.collect()) == Counter(r for r, k in zip(rows, kept, strict=True) if k)
    got = stages["exact dedup"](spark, docs, labelled)
    assert got.columns == docs.columns and Counter(norm(r.text) for r in got.collect()) == Counter({norm(r.text): 1 for r in rows})
    got = stages["minhash near-dedup"](spark, docs, labelled)
    blank = sum(not (r.text or "").strip(" \t\n\x0b\x0c\r") for r in rows)
    sets = {tuple((r.text or "").lower().split()) for r in rows} - {()}
    assert got.columns == docs.columns and got.count() == blank + len(sets)
    got = stages["mixing to target weights"](spark, docs, labelled)
    taken = Counter(got.collect())
    assert got.columns == docs.columns and set(taken) <= set(rows) and all(n <= 2 * Counter(rows)[r] for r, n in taken.items())
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = stages["sentencepiece encoding"](spark, docs, labelled).collect()
    assert len(got) == len(rows) and all(r["ids_"] == library.encode(r.text or "") and r["n_tokens"] == len(r["ids_"]) for r in got)


def test_pipeline_stages_of_nothing(spark, empty, labelled):  # noqa: F811
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, labelled).count() == 0, name


@pytest.mark.parametrize("edit", [lambda p: moved(p, 0, 0.8), lambda p: moved(p, 0, 0.7), lambda p: moved(p, 10)[5:59, 5:59], lambda p: media.edit(p, 350) + np.random.default_rng(1).normal(0, 6, (52, 54))], ids=["scale 0.8", "scale 0.7", "turn 10", "crop and noise"])
def test_media_recall_by_edit(spark, edit):
    pictures = media.paint(np.random.default_rng(11).normal(size=(40, 64)).astype(np.float32))
    frame = lambda rows: spark.createDataFrame(rows, "id long, media binary")
    asked = [(i, media.pgm(np.rint(np.clip(edit(pictures[i]), 0, 255)).astype(np.uint8))) for i in range(20)]
    got = {(r.query, r.match) for r in media.find_copies(frame(asked), frame([(i, media.pgm(p)) for i, p in enumerate(pictures)])).collect()}
    assert sum((i, i) in got for i in range(20)) >= 18 and sum(q != m for q, m in got) <= 2
