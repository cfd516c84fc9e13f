"""Planning of questions: which layer of memory they ask for, what they name, what time they mean."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The signals of each kind of question, in the order in which they count.
SIGNALS = {
    "causal": ["为什么", "为何", "因为", "导致", "造成", "引发", "根因", "根因是", "why", "because", "cause", "caused", "root cause", "lesson", "教训", "失败原因", "什么原因", "how did", "怎么回事"],
    "fact": ["是什么", "什么是", "what is", "what's", "what are", "preference", "偏好", "喜欢什么", "配置", "config", "技术栈", "tech stack", "用的什么", "使用什么", "哪个版本", "who is", "谁", "哪台", "多少", "how many", "how much"],
    "directory": ["目录", "recent decisions", "recent lessons", "最近的决定", "decision list", "list of"],
    "chain": ["链路", "链条", "链式", "连锁反应", "multi-hop", "chain", "trace", "连锁"],
}
TIME = ["yesterday", "today", "last week", "last month", "last year", "前天", "昨天", "上周", "上个月", "去年", "今年", "之前", "以前", "when", "什么时候", "何时"]
_DATED = "[-/年]"


def classify(query: Column) -> Column:
    """causal, fact, directory, chain or unified; a question about a time is one for a fact."""
    low = F.lower(query)
    out = None
    for intent, words in SIGNALS.items():
        hit = F.regexp_like(low, F.lit("|".join(map(re.escape, words))))
        out = F.when(hit, intent) if out is None else out.when(hit, intent)
    timed = F.regexp_like(low, F.lit("|".join(TIME))) | (F.regexp_like(low, F.lit("[0-9]")) & F.regexp_like(low, F.lit(_DATED)))
    return out.when(timed, "fact").otherwise("unified")


def classify_sql(rows: str) -> str:
    any_of = lambda words: "regexp_matches(lower(query), '" + "|".join(re.escape(w).replace("'", "''") for w in words) + "')"
    cases = " ".join(f"WHEN {any_of(w)} THEN '{i}'" for i, w in SIGNALS.items())
    return f"SELECT event_id, CASE {cases} WHEN {any_of(TIME)} OR (regexp_matches(query, '[0-9]') AND regexp_matches(query, '{_DATED}')) THEN 'fact' ELSE 'unified' END AS intent FROM ({rows})"


# Words of a question that name nothing; phrases of counting questions and of date arithmetic.
STOP = set(
    "how many what which who whom whose where when why do did does is are was were have has had i you we they he she it the a an of in on at to for with from by and or but not "
    "this that these those my your me need pick up return list all items kind types led leading worked bought am currently much more most total spent money get got going been "
    "being some any would could should will can".split()
)
AGGREGATION = ["how many", "how much", "list ", "which ", " all of ", " every ", "total", "sum", "amount", "average", "raised", "earned", "spent", "cost", "distance", "increase", "number of"]
DATE_MATH = ["days ago", "weeks ago", "months ago", "years ago", "hours ago", "long ago"]
_MONTHS = "january february march april may june july august september october november december".split()
_WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
_NUMBERS = "one two three four five six seven eight nine ten eleven twelve".split()
_DAY = 86_400
_UNITS = {"day": _DAY, "week": 7 * _DAY, "month": 30 * _DAY, "year": 365 * _DAY}
# How a question may say when, in the order in which the forms count.
_UNIT, _NUMBER, _MONTH = "(" + "|".join(_UNITS) + ")", "[0-9]+|" + "|".join(_NUMBERS), "(" + "|".join(_MONTHS) + ")"
_SAID = {
    "rolling": rf"(?:past|last|in the last|over the (?:last|past))\s+({_NUMBER})\s+{_UNIT}s?",
    "few": rf"past few {_UNIT}s?",
    "ago": rf"(a|an|{_NUMBER})\s+{_UNIT}s?\s+ago",
    "last": rf"\blast {_UNIT}\b",
    "past": rf"\bpast {_UNIT}\b",
    "this": rf"\bthis {_UNIT}\b",
    "year": r"since (?:the )?(?:start|beginning) of (?:the )?year",
    "since": rf"since {_MONTH}",
    "in": rf"\b(?:in|during) {_MONTH}\b",
    "yesterday": "yesterday",
    "weekday": "(?:last|on|this) (" + "|".join(_WEEKDAYS) + ")",
}


def entities(query: Column) -> Column:
    """Words of four bytes or more that are no stop words, each once, in order."""
    words = F.regexp_extract_all(F.lower(query), F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0))
    stop = F.array(*map(F.lit, sorted(STOP)))
    return F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 4) & ~F.array_contains(stop, w)))


def looks_aggregation(query: Column) -> Column:
    """Whether a question needs all evidence: counts, sums, lists; not date arithmetic."""
    low = F.lower(query)
    has = lambda words: F.regexp_like(low, F.lit("|".join(map(re.escape, words))))
    return has(AGGREGATION) & ~has(DATE_MATH) & ~(F.contains(low, F.lit("how many")) & F.contains(low, F.lit("between")))


def _one_of(value: Column, options: dict[str, int]) -> Column:
    out = None
    for name, number in options.items():
        out = F.when(value == name, F.lit(number).cast("long")) if out is None else out.when(value == name, F.lit(number).cast("long"))
    return out


def time_window(query: Column, now: Column) -> Column:
    """The span (start, end) of seconds, both in it, that a question asked at now means; the first form that fits counts, null where none does or its span has no sense.

    N units back, and a few (three), end now; "N units ago" is the unit that ended then; "last" is the whole
    week, month or year before, "this" the one that runs; months are of this year. A weekday is the latest
    before today. Days are UTC.
    """
    groups = {form: re.compile(pattern).groups for form, pattern in _SAID.items()}
    found = [F.regexp_extract(F.lower(query), pattern, g).alias(f"{form}{g}") for form, pattern in _SAID.items() for g in range(groups[form] + 1)]
    said = F.struct(*found, now.cast("long").alias("now"), F.date_from_unix_date(F.floor(now / _DAY).cast("int")).alias("today"))
    return F.transform(F.array(said), _window)[0]  # what was said is found once and used many times


def _window(said: Column) -> Column:
    now, today = said["now"], said["today"]
    part = lambda form, group: said[f"{form}{group}"]
    count = lambda c: F.when(c.try_cast("long") < 10**10, c.try_cast("long"))
    number = lambda c: F.when(c.isin("a", "an"), F.lit(1).cast("long")).otherwise(F.coalesce(_one_of(c, {w: i + 1 for i, w in enumerate(_NUMBERS)}), count(c)))
    unit = lambda form, group=1: _one_of(part(form, group), _UNITS)
    start = lambda day: F.unix_date(day).cast("long") * _DAY
    week, month, year = (F.to_date(F.trunc(today, u)) for u in ("week", "month", "year"))
    named = lambda form: F.make_date(F.year(today), _one_of(part(form, 1), {m: i + 1 for i, m in enumerate(_MONTHS)}).cast("int"), F.lit(1))
    back = F.pmod(F.weekday(today) - _one_of(part("weekday", 1), {d: i for i, d in enumerate(_WEEKDAYS)}), F.lit(7))
    on = start(today) - F.when(back == 0, F.lit(7)).otherwise(back) * _DAY
    span = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    of = lambda form, spans: F.when(part(form, 1) == "week", spans[0]).when(part(form, 1) == "month", spans[1]).when(part(form, 1) == "year", spans[2])
    ago = number(part("ago", 1)), unit("ago", 2)
    windows = {
        "rolling": span(now - number(part("rolling", 1)) * unit("rolling", 2), now),
        "few": span(now - 3 * unit("few"), now),
        "ago": span(now - (ago[0] + 1) * ago[1], now - ago[0] * ago[1]),
        "last": of("last", [span(start(week) - 7 * _DAY, start(week) - 1), span(start(F.add_months(month, -1)), start(month) - 1), span(start(F.add_months(year, -12)), start(year) - 1)]),
        "past": span(now - unit("past"), now),
        "this": of("this", [span(start(week), now), span(start(month), now), span(start(year), now)]),
        "year": span(start(year), now),
        "since": span(start(named("since")), now),
        "in": span(start(named("in")), start(F.add_months(named("in"), 1)) - 1),
        "yesterday": span(start(today) - _DAY, start(today) - 1),
        "weekday": span(on, on + _DAY - 1),
    }
    out = None
    for form, window in windows.items():
        fits = part(form, 0) != ""
        out = F.when(fits, window) if out is None else out.when(fits, window)
    return F.when(out["start"].isNotNull(), out)


def plan(questions: DataFrame, now: Column) -> DataFrame:
    """questions (qid, query) with the entities they name, the window of time they mean and whether they ask for all evidence."""
    return questions.withColumns({"entities": entities(F.col("query")), "window": time_window(F.col("query"), now), "aggregation": looks_aggregation(F.col("query"))})
