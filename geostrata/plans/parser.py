"""The query language.

    SELECT count() | topk(k) [, …] FROM name
    [WHERE condition AND …]      loc INSIDE name | text CONTAINS 'word' | time AFTER 'yyyy-MM-dd' | time AFTER n unit ago
    [GROUP BY level, … [ORDER BY column [asc | desc]]]
    [SYNC n second | minute | hour]

Case and white space don't count. Clauses are found outside of quotes, as whole words.
"""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import date

from geostrata.functions.spatial import WORLD, Rect
from geostrata.plans.query import WarehouseQuery
from geostrata.schema import DIMENSIONS, GROUPS, group_name

_MARK = "\0{}\0"
_CLAUSES = re.compile(r"(?<!\S)(select|from|where|group by|order by|sync)(?!\S)")
_AGGREGATE = re.compile(r"(?<![\w])(count|topk)\(([^)]*)\)")
_SECONDS = {"second": 1, "minute": 60, "hour": 3600}


class QuerySyntaxError(ValueError):
    """The text isn't a query of this language."""


def parse(sql: str, rect: Rect | None = None, query_id: int = 0, lenient: bool = False) -> WarehouseQuery:
    """The query that a text says. `rect` is what INSIDE refers to, the domain if there is none.

    Unknown levels and selected columns that aren't a measure are left out. Unknown conditions, and text that belongs
    to no clause, raise unless `lenient`. ORDER BY sorts by the measure, in descending order unless it says otherwise,
    and counts only together with GROUP BY.
    """
    quoted: list[str] = []
    bare = re.sub(r"'([^']*)'", lambda m: quoted.append(m[1].lower()) or _MARK.format(len(quoted) - 1), sql)
    text = " ".join(bare.lower().split())
    found = list(_CLAUSES.finditer(text))
    names = [m[1] for m in found]
    if names[:2] != ["select", "from"] or text[: found[0].start()]:
        raise QuerySyntaxError("a query begins with SELECT … FROM …")
    order = [n for n in ("select", "from", "where", "group by", "order by", "sync") if n in names]
    if names != order:
        raise QuerySyntaxError(f"clauses are repeated or out of order: {', '.join(names)}")
    clause = {m[1]: text[m.end() : (found[i + 1].start() if i + 1 < len(found) else len(text))].strip() for i, m in enumerate(found)}
    unquote = lambda x: re.sub(r"\0(\d+)\0", lambda m: quoted[int(m[1])], x)

    aggregates = _AGGREGATE.findall(clause["select"])
    if len(aggregates) != 1:
        raise QuerySyntaxError("exactly one of count() and topk(k) must be selected")
    measure, argument = aggregates[0]
    if measure == "topk" and not (argument.strip().isdigit() and int(argument) > 0):
        raise QuerySyntaxError("topk needs a positive number")
    if not lenient and len(clause["from"].split()) != 1:
        raise QuerySyntaxError(f"can't be read: {clause['from']!r}")
    q = WarehouseQuery(measure=measure, k=int(argument) if measure == "topk" else 10, query_id=query_id)
    for condition in re.split(r"\s+and\s+", clause["where"]) if clause.get("where") else ():
        q = _with_condition(q, condition, unquote, rect, lenient)
    if "group by" in clause:
        q = replace(q, group=_group(clause["group by"]))
        if "order by" in clause and measure == "count":
            words = clause["order by"].split()
            if not words:
                raise QuerySyntaxError("ORDER BY needs a column")
            q = replace(q, order_column=words[0].replace("()", ""), order="asc" if words[1:2] == ["asc"] else "desc")
    if "sync" in clause:
        m = re.fullmatch(r"(\d+) (second|minute|hour)s?", clause["sync"])
        if not m:
            raise QuerySyntaxError("SYNC needs a number of seconds, minutes or hours")
        q = replace(q, sync_seconds=int(m[1]) * _SECONDS[m[2]])
    return q


def _with_condition(q: WarehouseQuery, condition: str, unquote, rect: Rect | None, lenient: bool) -> WarehouseQuery:
    if re.fullmatch(r"loc inside \S+", condition):
        return replace(q, range=rect or WORLD)
    if m := re.fullmatch(r"text contains (\S.*)", condition):
        return replace(q, keywords=(*q.keywords, unquote(m[1]).strip()))
    if m := re.fullmatch(r"time after (\S.*)", condition):
        value = unquote(m[1]).strip()
        if ago := re.fullmatch(r"(\d+) \w+ ago", value):
            return replace(q, interval=int(ago[1]))
        if day := re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", value):
            try:
                return replace(q, after=date(*map(int, day.groups())))
            except ValueError as e:
                raise QuerySyntaxError(f"no such day: {value}") from e
        raise QuerySyntaxError(f"not a day: {value!r}")
    if lenient:
        return q
    raise QuerySyntaxError(f"unknown condition: {unquote(condition)!r}")


def _group(text: str) -> str:
    """Levels in the order of the dimensions; words that are no level are left out, as long as one is left."""
    if text == "*":
        return group_name(())
    levels = [x for part in text.split(",") for x in [" ".join(part.split())] if x]
    if any(" " in x for x in levels):
        raise QuerySyntaxError(f"levels are separated by commas: {text!r}")
    levels = [x for x in levels if x in DIMENSIONS]
    name = group_name(tuple(levels))
    if not levels or len(set(levels)) < len(levels) or name not in GROUPS:
        raise QuerySyntaxError(f"not one of the groupings: {text!r}")
    return name


def parse_request(text: str, lenient: bool = False) -> WarehouseQuery:
    """A request: the query, which may span lines, a line of four numbers (latitude and longitude from, then to) and one
    of the query's number."""
    try:
        sql, corners, number = text.strip("\n").rsplit("\n", 2)
        rect, query_id = Rect(*map(float, corners.split())), int(number)
    except (ValueError, TypeError) as e:
        raise QuerySyntaxError("a request has a query, four numbers and the number of the query") from e
    return parse(sql, rect, query_id, lenient)


def request(q: WarehouseQuery) -> str:
    """The request that `parse_request` reads as this query. What the language has no words for (a topic, closed ranges) and
    keywords with a quote raise."""
    if q.topic is not None or q.closed or any("'" in k for k in q.keywords) or (q.after and q.interval):
        raise ValueError("the query language can't say this query")
    where = ["loc INSIDE range"] if q.range else []
    where += [f"text CONTAINS '{k}'" for k in q.keywords]
    where += [f"time AFTER '{q.after.isoformat()}'"] if q.after else [f"time AFTER {q.interval} minute ago"] if q.interval else []
    sql = f"SELECT {'count()' if q.measure == 'count' else f'topk({q.k})'} FROM data" + (f" WHERE {' AND '.join(where)}" if where else "")
    if q.levels:
        sql += f" GROUP BY {', '.join(q.levels)}" + (f" ORDER BY {q.order_column or q.measure} {q.order}" if q.order else "")
    if q.sync_seconds:
        sql += f" SYNC {q.sync_seconds} second"
    r = q.range or WORLD
    return f"{sql}\n{r.lat_from} {r.lon_from} {r.lat_to} {r.lon_to}\n{q.query_id}"


def parse_fields(text: str, query_id: int = 0) -> WarehouseQuery:
    """The older form: tab-separated `measure:`, `group by:`, `range:` and `keywords:` (each may be missing)."""
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in text.split("\t")) if k.strip()}
    measure = _AGGREGATE.match(fields.get("measure", "count").lower())
    name = measure[1] if measure else fields.get("measure", "count").lower()
    if name not in ("count", "topk"):
        raise QuerySyntaxError(f"no such measure: {name!r}")
    corners = [float(x) for x in re.split(r"[,\s]+", fields.get("range", "").strip()) if x]
    if len(corners) not in (0, 4):
        raise QuerySyntaxError("a range has four numbers")
    words = tuple(x.lower() for x in re.split(r"[,\s]+", fields.get("keywords", "")) if x)
    group = fields.get("group by", "*").lower()
    levels = tuple(re.split(r"[,\s]+", group))
    if group not in ("*", "none", "") and group_name(levels) not in GROUPS:
        raise QuerySyntaxError(f"not one of the groupings: {group!r}")
    return WarehouseQuery(measure=name, k=int(measure[2]) if measure and measure[2].isdigit() else 10, group=group_name(levels), range=Rect(*corners) if corners else None, keywords=words, query_id=query_id)
