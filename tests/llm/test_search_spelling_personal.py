"""Ranked search, spelling variants and personal data against plain versions of their rules."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_operators import SCHEMA, awkward, empty, rows_of  # noqa: F401

from fieldbook.llm import lexical, personal_data, spelling

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def ranking(docs, items, k):
    terms = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    filled = [c for _, c in terms if c]
    n_docs, n_terms = len(filled), sum(c.total() for c in filled)
    df = Counter(w for c in filled for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(lower(t)))
    out = []
    for item, words in asked.items():
        found = []
        for i, c in terms:
            m = 10 + (90 * c.total() * n_docs) // n_terms if c else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(3)
    word = lambda: f"w{min(int(rng.expovariate(0.05)), 200)}"
    texts = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(300)]
    return texts + texts[:20] + ["Ünï W1-w2", "ΑΒΓ αβγ", None]


@pytest.mark.parametrize("shard_bytes", [500, 16_000_000])
def test_search_equals_scoring_every_document(spark, many, shard_bytes, tmp_path):
    docs = [*enumerate(many), (7, many[7]), (None, many[9])]
    items = [(1, many[3]), (1, "w0 w1"), (2, many[5] + " W199"), (3, None), (4, "nowhere"), (5, "W1 ünï"), (None, "w2 w3"), (6, "w2 w3"), (8, "αβγ")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = lexical.build_index(frame, shard_bytes=shard_bytes, path=str(tmp_path / "index"))
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranking(docs, items, 5)
    again = lexical.search(spark.read.parquet(str(tmp_path / "index")), spark.createDataFrame(items, "item_id long, text string"), k=1)
    assert sorted((tuple(r) for r in again.collect()), key=str) == ranking(docs, items, 1)  # a kept index serves further searches


def test_search_of_awkward_rows(spark, awkward, empty):
    docs = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    items = [(1, "one a b id"), (2, "12 テスト w")]
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, score int")
    assert sorted((tuple(r) for r in lexical.search(lexical.build_index(awkward), asked).collect()), key=str) == ranking(docs, items, 10)
    assert lexical.search(lexical.build_index(empty), asked).count() == 0
    assert lexical.search(lexical.build_index(awkward), asked.limit(0)).count() == 0
    names = lexical.build_index(awkward.selectExpr("concat('d', doc_id) AS doc_id", "text"))
    assert {r.doc_id for r in lexical.search(names, asked).where("item = 2").collect()} >= {"d9", "d11", "d12"}


def test_shards_equal_sums_of_all_lists():
    rng = np.random.default_rng(4)
    for trial in range(60):
        n, k = int(rng.integers(1, 5000)), int(rng.integers(1, 12))
        lists = []
        for _ in range(int(rng.integers(1, 12))):
            places = np.flatnonzero(rng.random(n) < rng.choice([0.001, 0.05, 0.7]))
            lists.append((places, rng.integers(1, rng.choice([3, 1000]), len(places))))
        total = np.zeros(n, np.int64)
        for places, scores in lists:
            total[places] += scores
        order = np.lexsort((np.arange(n), -total))[:k]
        order = order[total[order] > 0]
        at, scores = lexical.best_in_shard(lists, n, k)
        assert at.tolist() == order.tolist() and scores.tolist() == total[order].tolist()


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_errata_tries_give_each_near_pair_once():
    rng = random.Random(1)
    for _ in range(400):
        letters = "abc"[: rng.randrange(1, 4)]
        words = list({"".join(rng.choice(letters) for _ in range(rng.randrange(7))) for _ in range(rng.randrange(1, 40))})
        got = [frozenset((i, j)) for i, j, _, _ in spelling.one_edit_pairs(words)]
        assert len(got) == len(set(got))
        assert set(got) == {frozenset((i, j)) for i in range(len(words)) for j in range(i) if one_edit(words[i], words[j])}


def near(counts):
    out = {}
    for w, n in counts.items():
        if found := [(-counts[o], o) for o in counts if one_edit(w, o)]:
            out[w] = (len(found), min(found)[1], -min(found)[0])
    return out


@pytest.mark.parametrize("group", [20, 200_000])
def test_near_words_of_groups_dealt_again_by_halves(spark, group):
    rng = random.Random(2)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))): rng.randrange(3, 9) for _ in range(250)}
    words |= {"a" * 30 + x + y + "z" * 30: 5 for x in "abcdefgh" for y in "abcdéñ"} | {"a" * k: k for k in range(60, 66)}
    got = spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), group=group)
    assert {r.word: (r.n_near, r.form, r.form_n) for r in got.collect()} == near(words)


def variants_of(docs, every=97):
    counts = Counter()
    for i, text in docs:
        for run in re.findall(r"[a-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    close = near(words)
    form = {w: close[w][1] for w, n in words.items() if w in close and close[w][2] >= 2 * n}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, close.get(w, (0,))[0], words[form[w]] if w in form else None) for w, n in words.items()}


@pytest.fixture(scope="module")
def misspelt(spark):
    rng = random.Random(5)
    base = ["häuser", "Morning", "evening", "letters", "ÑANDÚES", "strasse"]
    wrong = lambda w: w[: (i := rng.randrange(len(w)))] + rng.choice("xé") * rng.randrange(2) + w[i + 1 :]
    texts = [" ".join(rng.choice([b, b, b, wrong(b)]) for b in rng.choices(base, k=40)) for _ in range(60)]
    texts.append("carrots " * 40 + "carrotts " * 12 + "carrottss " * 4)
    return [*enumerate(texts), (3, texts[3]), (None, texts[4]), (99, None), (100, ""), (101, "q" * 70_000), (102, "q" * 70_000), (103, "q" * 70_000 + " 1x" * 5)]


def test_variants_equal_brute_force_and_sql(spark, misspelt):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in misspelt], "doc_id long, text string, word string, n int").repartition(3)
    got = [tuple(r) for r in spelling.variants(frame).collect()]
    want = variants_of(misspelt)
    assert len(got) == len(want) and set(got) == want and any(r[2] not in (r[0], r[1]) for r in got)
    connection = duckdb.connect()
    connection.register("documents", pa.table({"doc_id": pa.array([i for i, t in misspelt if not t or len(t) < 9999], pa.int64()), "text": pa.array([t for _, t in misspelt if not t or len(t) < 9999], pa.string())}))
    assert set(connection.execute(spelling.OP12_SQL).fetchall()) == {r for r in want if len(r[0]) < 9999}


def test_variants_of_awkward_rows(spark, awkward, empty):
    docs = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert {tuple(r) for r in spelling.variants(awkward).collect()} == variants_of(docs)
    assert spelling.variants(empty).count() == 0


VALID_IBAN, BAD_IBAN = "DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00"
PERSONAL = [
    "mail me at a.b@c.de, or x@y or @z.de; a@b@c.d.e!",
    "10.0.0.1 and 300.1.1.1 then 1.2.3.4.5.6.7.8 0001.2.3.004",
    "card 4111 1111 1111 1111 not 4111-1111-1111-1112; 4111111111111111",
    "+1 (984) 555-5227 and +12 3 and +49-30-123456 ++49 30 123456",
    f"account {VALID_IBAN} or {BAD_IBAN}; GB82WEST12345698765432",
    "ssn 123-45-6789, code 123-45-6789 elsewhere far away from any telling word at all, ssn 000-12-3456",
    "call 0301 555 1234 today. " + "x" * 60 + " 0301 555 1234",
    "é@ü.de ñ +1 984 555 5227 ü 1.1.1.1 \x01\x02 call 555 123 4567",
    None,
    "",
    "tel 1.2.3.4 10.0.0.1",
]


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(personal_data.BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None, "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(6)
    texts = PERSONAL + ["".join(rng.choice("a1.@+- 25(.x%") for _ in range(rng.randrange(80))) for _ in range(4000)]
    for text in texts:
        got = [f"{k}:{a}:{b}" for k, a, b, _ in personal_data.spans_in(text or "") if k in personal_data.BASE]
        assert got == plain_base(text), text


def test_own_kinds_need_checks_and_words_nearby(spark):
    kinds = lambda text: [(k, text[a:b]) for k, a, b, _ in personal_data.spans_in(text)]
    assert kinds(PERSONAL[4]) == [("iban", VALID_IBAN), ("iban", "GB82WEST12345698765432")]
    assert kinds(PERSONAL[5]) == [("ssn", "123-45-6789")] * 2 or kinds(PERSONAL[5])[0] == ("ssn", "123-45-6789")
    assert [x for x in kinds(PERSONAL[6]) if x[0] == "local"] == [("local", "0301 555 1234")]
    scores = [s for _, _, _, s in personal_data.spans_in("card 4111111111111111" + " " * 90 + "4111111111111111")]
    assert scores[0] > scores[1] >= 0.8


def test_personal_data_equals_sql(spark, tmp_path, monkeypatch):
    table = pa.table({"doc_id": pa.array([*range(len(PERSONAL)), 0, None], pa.int64()), "text": pa.array([*PERSONAL, PERSONAL[0], PERSONAL[4]], pa.string())})
    import pyarrow.parquet as pq

    pq.write_table(table, tmp_path / "documents.parquet")
    frame = personal_data.op13_personal_data(spark, str(tmp_path))
    connection = duckdb.connect()
    connection.register("documents", table)
    result = connection.execute(personal_data.OP13_SQL)
    names = [d[0] for d in result.description]
    assert sorted(map(str, frame.select(*names).collect())) == sorted(str(spark.createDataFrame([r], frame.select(*names).schema).first()) for r in result.fetchall())
    first = next(r for r in frame.collect() if r.doc_id == 1)
    assert first.base_sha256 == hashlib.sha256(",".join(plain_base(PERSONAL[1])).encode()).hexdigest() and first.n_ip == 4


def test_personal_data_of_awkward_rows(spark, awkward, empty):
    named = awkward.withColumnRenamed("ids", "personal")
    found = personal_data.find_personal_data(named)
    assert found.columns == [*named.columns, "personal_"] and found.count() == named.count() and found.where("size(personal_) > 0").count() == 0
    assert personal_data.find_personal_data(empty).count() == personal_data.masked(empty).count() == 0
    docs = spark.createDataFrame(rows_of(["to a@b.de or 10.0.0.1!", None, "clean"]), SCHEMA)
    assert [r.text for r in personal_data.masked(docs).orderBy("doc_id").collect()] == ["to <email> or <ip>!", None, "clean"]


def test_time_grows_with_the_length_of_a_text():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + " " * 400_000, "a@b" * 130_000, "1 " * 200_000, "A1" * 200_000, "+" * 400_000):
        start = time.process_time()
        personal_data.spans_in(text)
        assert time.process_time() - start < 10


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_spelling", "op13_personal_data"])
def test_queries_equal_their_sql(spark, name):
    from fieldbook.llm import queries

    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    want = connection.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
