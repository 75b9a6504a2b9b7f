"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score (operator 13).

Four base kinds (mail addresses, IPv4 addresses, payment cards, international
telephone numbers) stand whatever their score. Kinds of our own stand if their
score, made of a start value, what a validator proves and whether a telling word
is near, reaches a threshold, and no span before them covers their place.
Patterns never run back over a text, so the time grows with its length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from fieldbook.llm.common import documents_of, fresh, per_text

# The patterns of the base kinds, in their order.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds of our own, in their order.
OWN = {
    "iban": r"\b[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30}|(\x20[A-Z0-9]{4}){2,7}(\x20[A-Z0-9]{1,3})?)\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "local": r"\b[0-9]{3,4}[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}\b",
}


@dataclass(frozen=True)
class Rule:
    """Score of a span that passed its validator, and words near it that add ``NEAR``."""

    start: float
    words: tuple[str, ...]


RULES = {
    "email": Rule(0.9, ("mail", "email", "contact", "write")),
    "ip": Rule(0.6, ("ip", "address", "host", "server")),
    "card": Rule(0.8, ("card", "visa", "credit", "payment")),
    "phone": Rule(0.8, ("phone", "tel", "call", "mobile", "fax")),
    "iban": Rule(0.8, ("iban", "account", "bank", "konto")),
    "ssn": Rule(0.4, ("ssn", "social", "security")),
    "local": Rule(0.4, ("phone", "tel", "call", "mobile", "fax")),
}
#: What a word within ``WINDOW`` code points of a span adds to its score; the score from which a span of our own kinds stands.
NEAR, WINDOW, LEAST = 0.2, 40, 0.5


def luhn(digits: str) -> bool:
    """Whether the digits' weighted sum, every second from the right doubled and its digits added, ends in 0."""
    doubled = sum(int(c) * 2 - 9 * (c > "4") for c in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + doubled) % 10 == 0


def mod_97(code: str) -> bool:
    """Whether a bank account number, its first four signs moved behind and letters read as 10 to 35, leaves 1 by 97."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


VALID: dict[str, Callable[[str], bool]] = {
    "email": lambda m: True,
    "ip": lambda m: all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m.split(".")),
    "card": lambda m: 12 <= len(d := _digits(m)) <= 19 and luhn(d),
    "phone": lambda m: 9 <= len(_digits(m)) <= 15,
    "iban": lambda m: 15 <= len(code := m.replace(" ", "")) <= 34 and mod_97(code),
    "ssn": _ssn,
    "local": lambda m: 9 <= len(_digits(m)) <= 11,
}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The spans of the base pattern for mail, found from the @: a long run without one isn't tried from each of its places."""
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL_PART:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


#: The patterns as they run: a run of digits is tried from its first one only, and never shortened.
_RUN = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[ -]?[0-9])+"),
    "phone": re.compile(BASE["phone"]),
    **{kind: re.compile(pattern, re.ASCII) for kind, pattern in OWN.items()},
}
_CONTEXT = {kind: re.compile(rf"\b(?:{'|'.join(rule.words)})\b", re.ASCII | re.IGNORECASE) for kind, rule in RULES.items()}


def spans_in(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all spans in ``text``, in code points, ordered by start and then kind."""
    found, own = [], []
    proposals = [("email", a, b) for a, b in emails(text)]
    if re.search("[0-9]", text):
        proposals += [(kind, m.start(), m.end()) for kind, pattern in _RUN.items() for m in pattern.finditer(text)]
    for kind, start, end in proposals:
        if VALID[kind](text[start:end]):
            around = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
            score = min(1.0, RULES[kind].start + NEAR * any(_CONTEXT[kind].search(x) for x in around))
            (found if kind in BASE else own).append((kind, start, end, score))
    order = [*BASE, *OWN]
    key = lambda s: (s[1], order.index(s[0]))
    base = sorted(found, key=key)
    at = reach = 0
    for span in sorted(own, key=key):
        while at < len(base) and base[at][1] < span[2]:
            reach, at = max(reach, base[at][2]), at + 1
        if span[3] >= LEAST and span[1] >= reach:
            found.append(span)
            reach = span[2]
    return sorted(found, key=key)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
_SPAN_TYPE = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())]))


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``personal`` (spans with kind, start, end, score) as last column.

    Its name is lengthened by ``_`` where the input has such a column. Places are
    code points, ends exclusive; spans are ordered by start and then kind. Texts
    are read whole, whatever their length; null counts as empty and gives no
    spans; repeated rows are alike; an empty table stays empty.
    """
    name = fresh("personal", docs.columns)

    def make() -> Callable[[list], list]:
        entry = lambda s: dict(zip(("kind", "start", "end", "score"), s, strict=True))
        return lambda texts: [[[entry(s) for s in spans_in(text)] if text else [] for text in texts]]

    return docs.mapInArrow(per_text(make, text_col, [name], [_SPANS]), StructType([*docs.schema.fields, StructField(name, _SPAN_TYPE)]))


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets; of spans that overlap the first counts."""

    def make() -> Callable[[list], list]:
        def mask(text: str | None) -> str | None:
            out, done = [], 0
            for kind, start, end, _ in spans_in(text or ""):
                if start >= done:
                    out += [text[done:start], f"<{kind}>"]
                    done = end
            return "".join([*out, text[done:]]) if out else text

        return lambda texts: [[mask(t) for t in texts]]

    name = fresh("masked", docs.columns)
    made = docs.mapInArrow(per_text(make, text_col, [name], [pa.string()]), StructType([*docs.schema.fields, StructField(name, StringType())]))
    return made.withColumn(text_col, made[name]).drop(name)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, numbers of base spans by kind, a digest of the base spans and all spans for every document."""
    found = find_personal_data(documents_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
    base = F.filter("personal", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("personal", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *(count(kind) for kind in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("personal")).alias("spans"))


def _op13_sql() -> str:
    """The same with marks put around the matches, whose lengths give the places."""
    order = [*BASE, *OWN]
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    valid = {
        "email": "TRUE",
        "ip": "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CASE WHEN length(ltrim(x, '0')) <= 3 THEN ('0' || ltrim(x, '0'))::INT END > 255)) = 0",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN substr({digits}, length({digits}) - i, 1)::INT ELSE substr({digits}, length({digits}) - i, 1)::INT * 2 - CASE WHEN substr({digits}, length({digits}) - i, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": "length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(m, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, b: CASE WHEN b > 9 THEN (a * 100 + b) % 97 ELSE (a * 10 + b) % 97 END) = 1",
        "ssn": "m[1:3] NOT IN ('000', '666') AND m[1:3] < '900' AND m[5:6] <> '00' AND m[8:11] <> '0000'",
        "local": f"length({digits}) BETWEEN 9 AND 11",
    }
    parts = []
    for kind in order:
        near = rf"(?i)\b(?:{'|'.join(RULES[kind].words)})\b"
        pattern = (BASE | OWN)[kind]
        parts.append(
            f"SELECT rn, '{kind}' AS kind, {order.index(kind)} AS k, s AS a, s + length(m) AS b, {RULES[kind].start} + CASE WHEN regexp_matches(substr(t, greatest(s - {WINDOW}, 0) + 1, s - greatest(s - {WINDOW}, 0)), '{near}') OR regexp_matches(substr(t, s + length(m) + 1, {WINDOW}), '{near}') THEN {NEAR} ELSE 0 END AS score "
            f"FROM (SELECT rn, t, split_part(x[i], chr(2), 1) AS m, (list_sum(list_transform(x[1:i - 1], lambda y: length(y))) - (i - 2))::BIGINT AS s FROM (SELECT *, unnest(range(2, len(x) + 1)) AS i FROM (SELECT rn, t, string_split(regexp_replace(t, '({pattern})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS x FROM d) p) q) z WHERE {valid[kind]}"
        )
    joined = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k)"
    base = f"k < {len(BASE)}"
    return (
        f"WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents),\nm AS MATERIALIZED ({chr(10).join(' UNION ALL ' * (i > 0) + p for i, p in enumerate(parts))}),\n"
        f"c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY a, k) AS place FROM m o WHERE NOT {base} AND score >= {LEAST} AND NOT EXISTS (SELECT 1 FROM m x WHERE x.rn = o.rn AND x.k < {len(BASE)} AND x.a < o.b AND x.b > o.a)),\n"
        "w(rn, place, kind, k, a, b, reach, stands) AS (SELECT rn, place, kind, k, a, b, b, TRUE FROM c WHERE place = 1 UNION ALL SELECT c.rn, c.place, c.kind, c.k, c.a, c.b, CASE WHEN c.a >= w.reach THEN c.b ELSE w.reach END, c.a >= w.reach FROM w JOIN c ON c.rn = w.rn AND c.place = w.place + 1),\n"
        f"s AS (SELECT rn, kind, k, a, b FROM m WHERE {base} UNION ALL SELECT rn, kind, k, a, b FROM w WHERE stands),\n"
        f"g AS (SELECT rn, {', '.join(f'count(*) FILTER (WHERE k = {i}) AS n_{kind}' for i, kind in enumerate(BASE))}, {joined.replace(')', '')}) FILTER (WHERE {base}) AS base, {joined} AS spans FROM s GROUP BY rn)\n"
        f"SELECT doc_id, {', '.join(f'coalesce(n_{kind}, 0) AS n_{kind}' for kind in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rn)"
    )


OP13_SQL = _op13_sql()
