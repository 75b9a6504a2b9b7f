"""The training-data operators on small tables: brute-force versions, libraries, and awkward rows."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldbook.llm import common, exact_dedup, langid, licenses, media, mixing, near_dedup, quality, sentencepieces, token_counts, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, n string, node int, key int, size string, locator string, copies int"
DIR = "/root/testdata/sf0.001"


def rows_of(texts, sources=None, langs=None, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["s"] * len(texts))[k], None, 0.5, "x", "x", 1, 2, "x", "x", 3) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


AWKWARD = [None, "", " \t\n", "one", "one", "ONE", "a b c d e f", "a b c d e f", "x" * 300_000, "w " * 100_000, "\x0b\x0c", "日本語 テスト", "12 34", "!!! ???"]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = rows_of(AWKWARD, sources=["a", None] * 7, langs=["en", None] * 7)
    return spark.createDataFrame(rows + rows[:3] + [(None, "null id", None, None, None, None, None, None, None, None, None, None, None)] * 2, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def test_exact_dedup_matches_grouping(spark, awkward):
    got = exact_dedup.exact_dedup(awkward).collect()
    rows = awkward.select("doc_id", "text").collect()
    groups = {}
    for r in rows:
        groups.setdefault(norm(r.text), []).append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
    want = Counter()
    for r in rows:
        group = groups[norm(r.text)]
        best = min(group)
        want[(r.doc_id, None if best[1] else best[2], len(group), hashlib.sha256(norm(r.text).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_copies(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(groups)


def test_exact_dedup_checks_bytes_when_digests_collide(spark):
    docs = spark.createDataFrame(rows_of(["aa", "a a", "ab", "ac", "b", "b ", "ca"]), SCHEMA)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, digest=lambda t: F.substring(t, 1, 1)).collect()}
    assert got == {0: (1, 2, False), 1: (1, 2, True), 2: (2, 1, True), 3: (3, 1, True), 4: (5, 2, False), 5: (5, 2, True), 6: (6, 1, True)}


def test_exact_dedup_keeps_state_over_batches(spark, tmp_path):
    docs = spark.createDataFrame(rows_of(["t%d" % (i % 5) for i in range(40)]), SCHEMA).repartition(6)
    got = exact_dedup.exact_dedup(docs, files_per_batch=1).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(i, 8) for i in range(5)} and len(got) == 40


def fill(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % 3]) for i, s in enumerate(names)}
    left, target, open_ = Fraction(sum(sizes.values())) * Fraction(share), {}, set(names)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not over:
            return target | {s: float(weight[s] * level) for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= most * sizes[s]
        open_ -= over


def test_mixing_meets_targets_and_repeats(spark):
    rng = random.Random(1)
    texts = ["w " * rng.randrange(0, 60) for _ in range(900)]
    sources = [rng.choice(["a", "a", "a", "b", "c", "d", None]) for _ in texts]
    docs = spark.createDataFrame(rows_of(texts, sources), SCHEMA)
    got = mixing.copies(docs, block=8).collect()
    sizes = Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(t.split())
    want = fill(sizes)
    taken = Counter()
    for r in got:
        assert r.size == len(texts[r.doc_id].split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s, target in want.items():
        assert abs(taken[s] - target) <= 60  # one document at most
    again = mixing.copies(docs, block=8).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)
    assert mixing.mix(docs, block=8).count() == sum(r.copies for r in got)


def test_mixing_rounding_is_unbiased(spark):
    docs = spark.createDataFrame(rows_of(["w " * (1 + i % 9) for i in range(60)], ["a", "b"] * 30), SCHEMA)
    runs = [{r.doc_id: r.copies for r in mixing.copies(docs, weights=(3, 1), share=0.6, seed=s, block=16).collect()} for s in range(6)]
    mean = np.mean([[run[i] for run in runs] for i in range(0, 60, 2)])
    ratio = fill({"a": sum(1 + i % 9 for i in range(0, 60, 2)), "b": sum(1 + i % 9 for i in range(1, 60, 2))}, (3, 1, 1), 0.6)["a"] / sum(1 + i % 9 for i in range(0, 60, 2))
    assert mean == pytest.approx(ratio, abs=0.12)


def brute_components(rows, size, part, whole):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both * whole >= (len(sets[a]) + len(sets[b]) - both) * part:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_dedup_matches_brute_force(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 90))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for _ in range(160):
        words = list(base[rng.randrange(12)])
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(50)}"
        texts.append(" ".join(words))
    texts += [None, "", "  ", "one", "ONE", "one two", "One  Two", texts[0], texts[0].upper()]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, words=3, similarity=(85, 100)).collect()}
    assert got == brute_components(enumerate(texts), 3, 85, 100)
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c if n else i for i, (n, c) in brute_components(enumerate(texts), 5, 80, 100).items()})


def test_near_dedup_blocks_join_what_leaders_miss(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup._Graph, "against_leaders", lambda self, members, turn: None)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(50):
        words = list(base)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(60)] = f"e{rng.randrange(99)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, words=3, similarity=(85, 100)).collect()}
    assert got == brute_components(enumerate(texts), 3, 85, 100)


def test_sketch_estimates_follow_similarity(spark):
    a = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 4000, dtype=np.uint64))
    planes = []
    for s in (a[:3000], a[300:3300]):
        low = near_dedup.minima(s)
        bits = (low[None, :] >> np.arange(4, dtype=np.uint32)[:, None]) & np.uint32(1)
        planes.append(np.packbits(bits.astype(bool), axis=1).reshape(-1).view(np.int64).tolist())
    frame = spark.createDataFrame([tuple(planes)], "a array<long>, b array<long>")
    assert frame.select(near_dedup.estimate(F.col("a"), F.col("b"))).first()[0] == pytest.approx(2700 / 3300, abs=0.12)


def test_token_counts_match_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rng = random.Random(2)
    texts = ["Hello don't we've I'LL", "<|startoftext|>abc<|endoftext|>", "ΣΑΣ", "日本語", "İstanbul", "ﬁ ½ Ⅷ", None, "", "''s !'s"]
    texts += ["".join(rng.choice([chr(rng.randrange(32, 127)), chr(rng.randrange(0x250)), chr(rng.randrange(1, 0x3000)), "'s ", "<|endoftext|>", " "]) for _ in range(30)) for _ in range(300)]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame(rows_of(texts), SCHEMA), WORDS).collect()}
    assert got == {i: len(library.encode(t or "").ids) for i, t in enumerate(texts)}


def test_sentencepieces_match_library_and_round_trip(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(3)
    texts = [None, "", " lead", "   three  spaces ", "a\nb\t c", "日本 語龘", "<s>x</s>"]
    texts += ["".join(rng.choice(["the", "tion", "  ", " ", "\n", chr(rng.randrange(32, 127)), chr(rng.randrange(0x20, 0x3000))]) for _ in range(25)) for _ in range(300)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    coded = sentencepieces.encode(docs, PIECES, into="pieces")
    got = {r.doc_id: (r.pieces, r.decoded) for r in sentencepieces.decode(coded, PIECES, "pieces").collect()}
    assert got == {i: (library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in enumerate(texts)}


def test_unigram_viterbi_matches_library(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    rng = random.Random(6)
    proto.pieces.add(piece="<unk>", score=0, type=2)
    for kind, name in ((3, "<s>"), (3, "</s>")):
        proto.pieces.add(piece=name, score=0, type=kind)
    seen = set()
    for n in (1, 1, 2, 3, 4):
        for _ in range(60):
            piece = "".join(rng.choice("abcd▁") for _ in range(n))
            if piece not in seen and "▁" not in piece[1:]:
                seen.add(piece)
                proto.pieces.add(piece=piece, score=-rng.uniform(1, 9) * (1 + n / 4), type=1)
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.remove_extra_whitespaces = False
    raw = proto.SerializeToString()
    library, encoder = sentencepiece.SentencePieceProcessor(model_proto=raw), sentencepieces.Encoder(sentencepieces.Pieces(raw))
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    assert [x.tolist() for x in encoder.encode(texts)] == library.encode(texts)


def test_license_base_places_match_brute_force(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "GNU General Public License gnu general public license", "MIT-License; cc by-nc mit: license", "commit license; mit licenses", "é cc by", None, "", "Licensed under teh Apache License, Version 2.0", "APACHE LICENSE" * 3]
    found = licenses.scan_licenses(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()
    for r in found:
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").encode().lower())
        want = sorted((k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.encode().split())
        assert r.n_words == len(words) and [(s.start, s.label) for s in r.base] == want
        assert 0 <= r.evidence <= 1
    labels = {r.doc_id: {s.label for s in r.notices} for r in found}
    assert labels[0] == {"apache-2.0"} and labels[7] == {"apache-2.0"} and labels[3] == set()


def test_toxicity_folds_and_excepts():
    model = toxicity.Model({toxicity.fold("loser"): 2.0, toxicity.fold("idiot"): 3.0, "iowei*": 2.0}, (toxicity.fold("idiot proof"),))
    hit = [x > 0 for x in model.measure(["a LOSER", "1os3r", "id1ot", "idiot proof", "closer", "lоѕer", "idiots!", "loweitum", None, ""])]
    assert hit == [True, True, True, False, False, True, True, True, False, False]


def held_out_accuracy(frame, labels, label):
    rows = frame.join(labels, "doc_id").where("held_out").collect()
    return np.mean([r.predicted == r[label] for r in rows])


def test_classifiers_on_held_out_labels(spark):
    big = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    assert held_out_accuracy(quality.op10_quality(spark, big), labels, "quality") > 0.97
    assert held_out_accuracy(toxicity.op8_toxicity(spark, big), labels, "toxic") > 0.93
    got = langid.op2_langid(spark, big).join(spark.read.parquet(f"{big}/documents.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_discriminant_is_the_gaussian_rule():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (500, 2)), rng.normal([3, 0], [0.5, 2], (500, 2))])
    y = np.repeat([0, 1], 500)
    model = quality.fit(x, y, 0, 0)
    z = (x - model.centre) / model.scale
    want = []
    for k in (0, 1):
        own = z[y == k]
        cov = np.cov(own, rowvar=False, bias=True)
        d = z - own.mean(0)
        want.append(np.log(500.5 / 1001) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (d @ np.linalg.inv(cov) * d).sum(1))
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(want[0] - want[1])), abs=1e-9)


def test_string_kernel_folds_to_one_product():
    texts, langs = ["the cat and the dog", "der hund und die katze", "le chien et le chat", "the bird with the fish", "die maus mit dem fisch", "la souris avec le poisson"], ["en", "de", "fr"] * 2
    model = langid.fit(texts, langs, landmarks=2)
    assert list(model.predict([*texts, "", "123", None])[0]) == [*langs, "und", "und", "und"]
    grams = [set(langid._slots(t).tolist()) for t in texts]
    kernel = [[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams]
    p = langid.presence(texts)
    assert p @ p.T == pytest.approx(np.array(kernel), abs=1e-5)


def png(grid):
    import zlib

    h, w = grid.shape
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    lines = b"".join(bytes([y % 2]) + (np.diff(grid[y].astype(int), prepend=0) % 256 if y % 2 else grid[y]).astype(np.uint8).tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_media_copies_are_found(spark):
    rng = np.random.default_rng(1)
    pictures = media.paint(rng.normal(size=(60, 64)))
    stored = [(i, media.pgm(p)) for i, p in enumerate(pictures)] + [(100, media.pgm(pictures[3])), (101, None), (102, b"junk"), (103, media.pgm(np.full((64, 64), 9, np.uint8))), (104, b"\x89PNG\r\n\x1a\n")]
    turned = np.rot90(pictures[5])
    asked = [(i, media.pgm(media.edit(pictures[i], i * 50))) for i in range(0, 60, 4)] + [(200, png(pictures[8])), (201, media.pgm(turned)), (202, None), (203, b"P5 9 9 255\n")]
    frame = lambda rows: spark.createDataFrame(rows, "id long, media binary")
    got = {(r.query, r.match) for r in media.find_copies(frame(asked), frame(stored)).collect()}
    want = {(i, i) for i in range(0, 60, 4)} | {(200, 8), (201, 5)}
    assert len(got & want) >= 0.9 * len(want) and not got - want
    assert media.find_copies(frame([]), frame([])).count() == 0
    assert (media.decode_image(png(pictures[8])) == pictures[8]).all()


def test_awkward_rows_pass_everywhere(spark, awkward):
    n = awkward.count()
    labels = awkward.select("doc_id", (F.col("doc_id") % 2).alias("label"))
    docs = awkward.select("doc_id", "text", "lang")
    assert mixing.copies(awkward).count() == n
    got = near_dedup.near_duplicates(awkward)
    assert got.count() == n
    assert token_counts.count_tokens(awkward, WORDS).count() == n
    assert sentencepieces.encode(awkward, PIECES, into="pieces").count() == n
    assert licenses.scan_licenses(awkward).where("n_words = 0").count() == 8
    assert quality.score(awkward, quality.train(docs, labels), into="q").where("q between 0 and 1").count() == n
    assert toxicity.score(awkward, toxicity.train(docs, labels), into="q").where("q between 0 and 1").count() == n
    told = langid.identify(awkward, langid.train(docs)).collect()
    assert len(told) == n and all(r.lang_pred == "und" for r in told if not r.text or not re.search(r"[^\W\d_]", r.text))


def test_empty_tables_stay_empty(spark, empty):
    labels = empty.select("doc_id", F.lit(1).alias("label"))
    docs = empty.select("doc_id", "text", "lang")
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert mixing.copies(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert licenses.scan_licenses(empty).count() == 0
    assert quality.score(empty, quality.train(docs, labels), into="q").count() == 0
    assert toxicity.score(empty, toxicity.train(docs, labels), into="q").count() == 0
    assert langid.identify(docs, langid.train(docs)).count() == 0


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    from fieldbook.session import materialize

    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, materialize(stage(spark, docs, DIR), "test-stage")
        if i < 4:
            assert docs.columns == columns
        if i == 1:
            texts = [norm(r.text) for r in before.collect()]
            assert docs.count() == len(set(texts)) == len({norm(r.text) for r in docs.collect()})
        if i == 2:
            want = brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80, 100)
            assert sorted(r.doc_id for r in docs.collect()) == sorted({c for _, c in want.values()})
    assert docs.where("size(ids) <> n_tokens").count() == 0 and docs.count() > 0


def moved(picture, degrees, scale=1.0):
    """A picture turned about its middle and resized, bilinear."""
    h, w = picture.shape
    yy, xx = np.mgrid[: int(h * scale), : int(w * scale)].astype(float)
    z = np.exp(-1j * np.deg2rad(degrees)) * ((xx - (int(w * scale) - 1) / 2) + 1j * (yy - (int(h * scale) - 1) / 2)) / scale + complex((w - 1) / 2, (h - 1) / 2)
    y, x = np.clip(z.imag, 0, h - 1.001), np.clip(z.real, 0, w - 1.001)
    fy, fx, y, x, p = y % 1, x % 1, y.astype(int), x.astype(int), picture.astype(float)
    return p[y, x] * (1 - fy) * (1 - fx) + p[y + 1, x] * fy * (1 - fx) + p[y, x + 1] * (1 - fy) * fx + p[y + 1, x + 1] * fy * fx


def test_media_noise_size_and_angle(spark):
    """Copies with noise, of another size, turned by an odd angle, or cut from the quiet corner of a large picture."""
    rng = np.random.default_rng(3)
    pictures = media.paint(rng.normal(size=(40, 64)))
    large = media.paint(rng.normal(size=(1, 1024)), 320)[0]
    large = np.where(np.add.outer(np.arange(320), np.arange(320)) < 360, large, 100 + large * 0.2)
    whole = lambda p: media.pgm(np.rint(np.clip(p, 0, 255)).astype(np.uint8))
    stored = [(i, media.pgm(p)) for i, p in enumerate(pictures)] + [(100, whole(large)), (101, media.pgm(np.full((64, 64), 9, np.uint8)))]
    kinds = [lambda p: media.edit(p, 0) + rng.normal(0, 6, (52, 54)), lambda p: moved(p, 0, 0.8), lambda p: moved(p, 17)[6:58, 6:58], lambda p: moved(p, 0, 1.5)]
    asked = [(1000 * k + i, whole(kind(pictures[i]))) for k, kind in enumerate(kinds) for i in range(10)]
    asked += [(9000, whole(large[220:, 220:])), (9001, whole(moved(large, 0, 0.5))), (9002, whole(moved(large, 33)[60:260, 60:260])), (9003, stored[-1][1])]
    frame = lambda rows: spark.createDataFrame(rows, "id long, media binary")
    got = {(r.query, r.match) for r in media.find_copies(frame(asked), frame(stored)).collect()}
    want = {(1000 * k + i, i) for k in range(4) for i in range(10)}
    assert {(9000, 100), (9001, 100), (9002, 100), (9003, 101)} <= got
    found = [len({g for g in got & want if g[0] // 1000 == k}) for k in range(4)]
    assert min(found) >= 7, found
    assert not got - want - {(9000, 100), (9001, 100), (9002, 100), (9003, 101)}


def test_encoder_memory_is_bounded(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 1_000_000] * 30})
    pool, before = pa.proxy_memory_pool(pa.default_memory_pool()), pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        assert sum(part.num_rows for part in common.slices(batch, "text")) == 30
    finally:
        pa.set_memory_pool(before)
    assert pool.max_memory() < 1_000_000  # no copy of the texts
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        encoder = sentencepieces.Encoder(sentencepieces.Pieces(f.read()))
    monkeypatch.setattr(sentencepieces, "REMEMBERED", 50)
    for i in range(20):
        encoder.encode(["often seen " + " ".join(f"word{i}x{j}" for j in range(40))])
        assert len(encoder.memo) <= 50 + 42
    assert {sentencepieces.MARK + "often", sentencepieces.MARK + "seen"} <= encoder.memo.keys()
    known = encoder.memo[sentencepieces.MARK + "often"]
    encoder.encode(["often new"])
    assert encoder.memo[sentencepieces.MARK + "often"] is known  # units in use are not encoded again


def test_smoothed_pictures_are_remembered_within_bounds(monkeypatch):
    pictures = media.paint(np.random.default_rng(4).normal(size=(5, 64)))
    decoded, decode = [], media.decode_image
    monkeypatch.setattr(media, "decode_image", lambda data: decoded.append(data) or decode(data))
    monkeypatch.setattr(media, "REMEMBERED", 3 * 64 * 64)
    of = media._smoothed()
    for i in (0, 1, 0, 1, 0):
        assert (of(b"%d" % i, media.pgm(pictures[i])) == media._smooth(pictures[i].astype(np.float32)[None], 1)[0]).all()
    assert len(decoded) == 2
    for i in (2, 3, 4, 0):
        of(b"%d" % i, media.pgm(pictures[i]))
    assert len(decoded) == 6  # the fifth picture came upon a full memory


def test_short_units_are_encoded_in_blocks_as_the_library_does(monkeypatch):
    import sentencepiece

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        raw = f.read()
    library, encoder = sentencepiece.SentencePieceProcessor(model_proto=raw), sentencepieces.Encoder(sentencepieces.Pieces(raw))
    walked, walk = [], sentencepieces.Encoder._bpe_units
    monkeypatch.setattr(sentencepieces.Encoder, "_bpe_units", lambda self, units: walked.extend(units) or walk(self, units))
    monkeypatch.setattr(sentencepieces, "BLOCK", 100)
    encoder.stays, encoder.steps = sentencepieces.Slots(encoder._pairs_stay, 3, bool), sentencepieces.Slots(encoder.pieces.step, 3)  # keys push each other out
    rng = random.Random(9)
    parts = ["the", "tion", "er", "é", "日本", "龘", "\U0001f600", *"abxyz09.,"]
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(40)) for _ in range(30)] + ["x" * n for n in (1, 63, 64, 65, 200)]
    assert [x.tolist() for x in encoder.encode(texts)] == library.encode(texts)
    assert {len(unit) for unit in walked} == {65, 66, 201}  # only long units go one by one; each text's first has a mark


def test_media_groups_are_counted_exactly():
    rng = np.random.default_rng(2)
    alone = np.unique(rng.integers(0, 1 << 40, 500_000))
    rng.shuffle(alone)
    assert not media._frequent(alone).any()  # a table of 4 million hashes took some of these for groups
    for top in (1 << 8, 1 << 62):
        group = rng.integers(0, top, 300)[rng.integers(0, 300, 900)]
        values, counts = np.unique(group, return_counts=True)
        assert (media._frequent(group) == np.isin(group, values[counts >= media.LEAST_VOTES])).all()
    assert media._frequent(np.zeros(0, np.int64)).tolist() == [] and media._frequent(np.zeros(3, np.int64)).tolist() == [False] * 3
