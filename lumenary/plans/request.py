"""What a typed search asks for: fields, favourites, a span of time, and words for the engines."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The words that searches are understood by.
FIELDS = r"\b(person|people|tag|camera|place|folder|filename|type|in|from):\s*(\"[^\"]+\"|'[^']+'|\S+)"
FAVOURITE = r"\b(favou?rites?|starred)\b"
IGNORED = "photos photo pictures picture pics pic images image of the a an with and show me find in at on my all from taken some any".split()
MONTHS = "january february march april may june july august september october november december".split()
SEASONS = {"spring": (3, 5), "summer": (6, 8), "autumn": (9, 11), "fall": (9, 11), "winter": (12, 2)}
DAYS = {"day": 1, "week": 7, "month": 31, "year": 365}


@dataclass
class Request:
    """A search: words for the engines, the values that each field must fit, a span in seconds since 1970 (both ends
    included, None open), and whether favourites, or photos with or without faces, are wanted."""

    text: str = ""
    only: dict[str, list[str]] = field(default_factory=dict)
    span: tuple[int | None, int | None] = (None, None)
    favorite: bool = False
    faces: bool | None = None


def _months(now, year, first, last=None, last_year=None):
    """From the first second of a month to the last one of another, in the zone of `now`."""
    last, last_year = last or first, last_year or year
    end = calendar.monthrange(last_year, last)[1]
    return datetime(year, first, 1, tzinfo=now.tzinfo), datetime(last_year, last, end, 23, 59, 59, tzinfo=now.tzinfo)


def _day(now, back):
    return (now - timedelta(days=back)).replace(hour=0, minute=0, second=0, microsecond=0)


def _season(now, found):
    first, last = SEASONS[found["season"].lower()]
    year = int(found["y"]) if found["y"] else now.year - ((found["which"] or "").lower() == "last")
    return _months(now, year, first, last, year + (first > last))


def _bare_month(now, found):
    month = MONTHS.index(found["m"].lower()) + 1
    return _months(now, now.year - (month > now.month), month)


_MONTH = f"(?P<m>{'|'.join(MONTHS)})"
#: The first pattern that occurs gives the span, and its first occurrence leaves the text. Yesterday ends with midnight.
SPANS = [
    (r"\btoday\b", lambda now, _: (_day(now, 0), now)),
    (r"\byesterday\b", lambda now, _: (_day(now, 1), _day(now, 1) + timedelta(days=1))),
    (r"\blast (?P<unit>week|month|year)\b", lambda now, g: (now - timedelta(days=DAYS[g["unit"].lower()]), now)),
    (r"\bpast (?P<n>\d+) (?P<unit>day|week|month|year)s?\b", lambda now, g: (now - timedelta(days=int(g["n"]) * DAYS[g["unit"].lower()]), now)),
    (rf"\b(?:(?P<which>last|this)\s+)?(?P<season>{'|'.join(SEASONS)})(?:\s+(?P<y>20\d\d))?\b", _season),
    (rf"\b{_MONTH}\s+(?P<y>20\d\d)\b", lambda now, g: _months(now, int(g["y"]), MONTHS.index(g["m"].lower()) + 1)),
    (r"\b(?P<y>20\d\d)\b", lambda now, g: _months(now, int(g["y"]), 1, 12)),
    (rf"\b{_MONTH}\b", _bare_month),
]


#: What becomes of a field's value: the condition that it adds to, or that it sets; `type:` has none.
_ADDS = {"person": "person", "people": "person", "tag": "tag"}
_SETS = {"camera": "camera", "place": "place", "in": "place", "from": "place", "folder": "folder", "filename": "filename"}


def understand(raw: str, now: datetime | None = None) -> Request:
    """The request that `raw` makes at the time `now`. People and tags add up, of other fields the last counts, `type:` is dropped."""
    now = now or datetime.now()
    only: dict[str, list[str]] = {}

    def take(found: re.Match) -> str:
        name, value = found[1].lower(), found[2]
        if len(value) > 1 and value[0] in "\"'" and value[0] == value[-1]:
            value = value[1:-1]
        if name in _ADDS:
            only.setdefault(_ADDS[name], []).append(value.lower() if name == "tag" else value)
        elif name in _SETS:
            only[_SETS[name]] = [value]
        return " "

    text = re.sub(FIELDS, take, raw, flags=re.I)
    text, favourites = re.subn(FAVOURITE, " ", text, flags=re.I)
    span: tuple[int | None, int | None] = (None, None)
    for pattern, ends in SPANS:
        found = re.search(pattern, text, re.I)
        if found:
            try:
                span = tuple(int(t.timestamp()) for t in ends(now, found.groupdict()))
            except OverflowError:  # longer ago than the calendar goes
                span = (None, int(now.timestamp()))
            text = text[: found.start()] + " " + text[found.end() :]
            break
    words = " ".join(w for w in text.split() if w.lower() not in IGNORED)
    return Request(words, only, span, favourites > 0)


def _zone(now: datetime) -> str | None:
    """The zone of a time as SQL names it; None for a time without one, which is the session's."""
    if now.tzinfo is None:
        return None
    if getattr(now.tzinfo, "key", None):
        return now.tzinfo.key
    minutes = int(now.utcoffset().total_seconds()) // 60
    return f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"


def _pattern(p: str) -> str:
    """A pattern of `re` as Java takes it, whatever the case, with letters and blanks of all scripts."""
    return "(?iuU)" + re.sub(r"\?P<(\w+)>", "", p)


def _spans(text: Column, now: datetime) -> tuple[Column, Column, Column]:
    """(begin, end, the text without it) of the first kind of span that a text holds; the same as SPANS, in expressions."""
    zone, at = _zone(now), int(now.timestamp())
    day = lambda back: F.lit(int(_day(now, back).timestamp())).cast("long")
    part = lambda k, g: F.lower(F.regexp_extract(text, _pattern(SPANS[k][0]), g))
    number = lambda k, g: F.try_to_number(part(k, g), F.lit("9999")).cast("int")
    place = lambda names, word: F.array_position(F.array(*map(F.lit, names)), word).cast("int")

    def of(table: dict, word: Column) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), word)

    def first(year: Column, month: Column) -> Column:
        """The first second of a month; the 13th is the next year's first."""
        over = (month > 12).cast("int")
        parts = [year + over, month - 12 * over, *(F.lit(x) for x in (1, 0, 0, 0))]
        return F.unix_seconds(F.make_timestamp(*parts, *([F.lit(zone)] if zone else [])))

    def months(year, begin, end=None, last=None):
        return first(year, begin), first(year if last is None else last, (begin if end is None else end) + 1) - 1

    back = F.when(F.length(part(3, 1)) <= 6, F.lit(at) - part(3, 1).try_cast("long") * of(DAYS, part(3, 2)) * 86_400)
    named, begin, end = part(4, 2), *(of({n: m[i] for n, m in SEASONS.items()}, part(4, 2)) for i in (0, 1))
    year = F.coalesce(number(4, 3), F.lit(now.year) - (part(4, 1) == "last").cast("int"))
    bare = place(MONTHS, part(7, 1))
    ends = [
        (day(0), F.lit(at)),
        (day(1), F.lit(int((_day(now, 1) + timedelta(days=1)).timestamp()))),
        (F.lit(at) - of(DAYS, part(2, 1)) * 86_400, F.lit(at)),
        (F.when(back >= int(datetime(1, 1, 2, tzinfo=timezone.utc).timestamp()), back), F.lit(at)),
        months(year, begin, end, year + (begin > end).cast("int")),
        months(number(5, 2), place(MONTHS, part(5, 1))),
        months(number(6, 1), F.lit(1), F.lit(12)),
        months(F.lit(now.year) - (bare > now.month).cast("int"), bare),
    ]
    out = [F.lit(None).cast("long"), F.lit(None).cast("long"), text]
    for (pattern, _), (low, high) in reversed(list(zip(SPANS, ends))):
        p = F.lit(_pattern(pattern))
        there, found = F.regexp_instr(text, p), F.regexp_extract(text, _pattern(pattern), 0)
        left = F.concat(F.substring(text, F.lit(1), there - 1), F.lit(" "), F.substring(text, there + F.length(found), F.length(text)))
        out = [F.when(there > 0, new).otherwise(old) for new, old in zip((low.cast("long"), high.cast("long"), left), out)]
    return tuple(out)


def understood(texts: DataFrame, column: str, now: datetime) -> DataFrame:
    """`texts` with a struct column `request` for a column of searches: as `understand` has it, in expressions; null is empty."""
    raw, fields = F.coalesce(F.col(column), F.lit("")), _pattern(FIELDS)
    given = F.arrays_zip(F.regexp_extract_all(raw, F.lit(fields), F.lit(1)).alias("name"), F.regexp_extract_all(raw, F.lit(fields), F.lit(2)).alias("value"))

    def plain(x):
        quoted = (F.length(x) > 1) & F.substring(x, 1, 1).isin("'", '"') & (F.substring(x, 1, 1) == F.substring(x, -1, 1))
        return F.when(quoted, F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)

    def values(*names):
        return F.transform(F.filter("_given", lambda g: F.lower(g["name"]).isin(*names)), lambda g: plain(g["value"]))

    def last(*names):
        return F.slice(F.reverse(values(*names)), 1, 1)

    out = texts.withColumn("_given", given).withColumn("_text", F.regexp_replace(raw, fields, " "))
    out = out.withColumn("_favorite", F.regexp_like("_text", F.lit(_pattern(FAVOURITE)))).withColumn("_text", F.regexp_replace("_text", _pattern(FAVOURITE), " "))
    low, high, left = _spans(F.col("_text"), now)
    words = F.filter(F.split(left, r"(?U)[\s\x1c-\x1f]+"), lambda w: (w != "") & ~F.lower(w).isin(*IGNORED))
    by = {field: [n for n, f in (_ADDS | _SETS).items() if f == field] for field in ("person", "tag", "camera", "place", "folder", "filename")}
    found = {f: F.transform(values(*n), F.lower) if f == "tag" else values(*n) if f == "person" else last(*n) for f, n in by.items()}
    request = F.struct(F.array_join(words, " ").alias("text"), *(c.alias(f) for f, c in found.items()), low.alias("date_from"), high.alias("date_to"), F.col("_favorite").alias("favorite"))
    return out.withColumn("request", request).drop("_given", "_text", "_favorite")


#: The fixed clock of the registered queries.
NOW = datetime.fromisoformat("2024-07-10T12:00:00+00:00")


def searches_understood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of the conversations, read as a search."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return understood(turns, "text", NOW).select("conv_id", "turn", "request.text", "request.date_from", "request.date_to", "request.favorite")


#: What the searches of all kinds are made of: one of each part, by the document's id, around its first words.
BEFORE = ["", "photos of ", "favourite ", "tag:FR ", "person:'Ann Lee' starred ", "show me "]
AFTER = [" today", " yesterday", " last week", " past 3 months", " last summer", " winter 2021", " march 2020", " 2019", " may", " October", " folder:a/b", " past 99999999 years", " camera:x camera:y place:\"New York\""]


def searches_of_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches made of the first words of documents with fields, favourites and every way to give a time; what is understood of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pick = lambda parts: F.element_at(F.array(*(F.lit(p) for p in parts)), (F.col("doc_id") % len(parts) + 1).cast("int"))
    made = docs.select("doc_id", F.concat(pick(BEFORE), F.substring("text", 1, 40), pick(AFTER)).alias("search"))
    fields = [F.array_join(f"request.{f}", "|").alias(f) for f in ("person", "tag", "camera", "place", "folder")]
    return understood(made, "search", NOW).select("doc_id", "request.text", "request.date_from", "request.date_to", "request.favorite", *fields)


def _sql(source: str, key: str, text: str, fields: str = "") -> str:
    """The same in SQL for DuckDB, at the time NOW."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    plain = [re.sub(r"\?P<\w+>", "", p) for p, _ in SPANS]
    now, day = int(NOW.timestamp()), 86_400
    midnight = now - now % day
    months = "list_position([" + ", ".join(f"'{m}'" for m in MONTHS) + "], lower({}))"
    begin = "epoch(make_date(({y})::int, ({m})::int, 1)::timestamp)::bigint"
    end = "epoch(make_date(({y})::int, ({m})::int, 1)::timestamp + interval 1 month)::bigint - 1"
    unit = "case lower({}) " + " ".join(f"when '{u}' then {n}" for u, n in DAYS.items()) + " end"
    part = lambda k, g: f"regexp_extract(t, {quoted(plain[k])}, {g}, 'i')"
    season = lambda k: "case lower(" + part(4, 2) + ") " + " ".join(f"when '{n}' then {m[k]}" for n, m in SEASONS.items()) + " end"
    year = f"coalesce(nullif({part(4, 3)}, '')::int, {NOW.year} - (lower({part(4, 1)}) = 'last')::int)"
    bare, of = months.format(part(7, 1)), months.format(part(5, 1))
    bare_year = f"{NOW.year} - ({bare} > {NOW.month})::int"
    far = f"try_cast({part(3, 1)} as bigint)"
    spans = [
        (str(midnight), str(now)),
        (str(midnight - day), str(midnight)),
        (f"{now} - {day} * {unit.format(part(2, 1))}", str(now)),
        (f"case when {far} <= 700000 then {now} - {day} * {far} * {unit.format(part(3, 2))} end", str(now)),
        (begin.format(y=year, m=season(0)), end.format(y=f"{year} + ({season(0)} > {season(1)})::int", m=season(1))),
        (begin.format(y=part(5, 2), m=of), end.format(y=part(5, 2), m=of)),
        (begin.format(y=part(6, 1), m="1"), end.format(y=part(6, 1), m="12")),
        (begin.format(y=bare_year, m=bare), end.format(y=bare_year, m=bare)),
    ]
    which = "case " + " ".join(f"when regexp_matches(t, {quoted(p)}, 'i') then {k}" for k, p in enumerate(plain)) + " end"
    case = lambda side: "case k " + " ".join(f"when {k} then {s[side]}" for k, s in enumerate(spans)) + " end"
    rest = "case k " + " ".join(f"when {k} then regexp_replace(t, {quoted(p)}, ' ', 'i')" for k, p in enumerate(plain)) + " else t end"
    ignored = ", ".join(f"'{w}'" for w in IGNORED)
    return f"""
with a as (select {key}{fields}, regexp_replace(coalesce({text}, ''), {quoted(FIELDS)}, ' ', 'gi') as t from {source}),
b as (select * exclude (t), regexp_matches(t, {quoted(FAVOURITE)}, 'i') as favorite, regexp_replace(t, {quoted(FAVOURITE)}, ' ', 'gi') as t from a),
c as (select *, {which} as k from b)
select * exclude (t, k, favorite), array_to_string(list_filter(string_split_regex({rest}, '[\\s\\x1c-\\x1f\\x85\\xa0]+'), lambda w: w <> '' and lower(w) not in ({ignored})), ' ') as text,
  ({case(0)})::bigint as date_from, ({case(1)})::bigint as date_to, favorite from c
"""


def _all_kinds_sql() -> str:
    pick = lambda parts: "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in parts) + f"][doc_id % {len(parts)} + 1]"
    kinds = {"person": (BEFORE, {4: "Ann Lee"}), "tag": (BEFORE, {3: "fr"}), "camera": (AFTER, {12: "y"}), "place": (AFTER, {12: "New York"}), "folder": (AFTER, {10: "a/b"})}
    fields = "".join(f", case doc_id % {len(parts)} " + " ".join(f"when {k} then '{v}'" for k, v in values.items()) + f" else '' end as {name}" for name, (parts, values) in kinds.items())
    return _sql("documents", "doc_id", f"{pick(BEFORE)} || substr(text, 1, 40) || {pick(AFTER)}", fields)


UNDERSTOOD_SQL = _sql("conversations", "conv_id, turn", "text")
ALL_KINDS_SQL = _all_kinds_sql()
