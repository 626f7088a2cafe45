"""Schema conformance and differences between two versions of a resume."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from matchloom import schemas as S
from matchloom.functions import text as X


def _problem(condition: Column, text: str) -> Column:
    return F.when(condition, F.lit(text))


def _list(c: Column, ddl: str) -> Column:
    return F.coalesce(c, F.array().cast(ddl))


def resume_problems(resume: Column | str) -> Column:
    """Required fields of a canonical resume, its roles and its projects."""
    r = X.col(resume)
    top = [_problem(r[n].isNull(), f"{n}: required") for n in ("summary", "experience", "skills")]
    roles = F.transform(
        _list(r["experience"], f"array<{S.ROLE}>"),
        lambda role: F.array(
            *[
                _problem(role[n].isNull(), f"experience.{n}: required")
                for n in ("title", "company", "startDate", "endDate", "achievements")
            ]
        ),
    )
    projects = F.transform(
        _list(r["projects"], f"array<{S.PROJECT}>"),
        lambda p: F.array(*[_problem(p[n].isNull(), f"projects.{n}: required") for n in ("name", "description")]),
    )
    return F.array_compact(F.concat(F.array(*top), F.flatten(roles), F.flatten(projects)))


def competency_problems(doc: Column | str) -> Column:
    d = X.col(doc)
    top = [_problem(d["competencies"].isNull(), "competencies: required")]
    items = F.transform(
        _list(d["competencies"], "array<struct<name:string,priority:int,evidenceIndicators:array<string>>>"),
        lambda c: F.array(
            _problem(c["name"].isNull(), "competencies.name: required"),
            _problem(c["priority"].isNull(), "competencies.priority: required"),
            _problem(~c["priority"].between(1, 5), "competencies.priority: not in 1..5"),
        ),
    )
    return F.array_compact(F.concat(F.array(*top), F.flatten(items)))


def delta_problems(doc: Column | str) -> Column:
    d = X.col(doc)
    top = [_problem(d["changes"].isNull(), "changes: required")]
    items = F.transform(
        _list(d["changes"], "array<struct<section:string,action:string,detail:string,rationale:string,evidence:array<string>>>"),
        lambda c: F.array(
            *[_problem(c[n].isNull(), f"changes.{n}: required") for n in ("section", "action", "detail")],
            _problem(~c["action"].isin("add", "update", "remove"), "changes.action: not add, update or remove"),
        ),
    )
    return F.array_compact(F.concat(F.array(*top), F.flatten(items)))


PROBLEMS = {"resume": resume_problems, "competencies": competency_problems, "delta": delta_problems}


def schema_conformance(df: DataFrame, kind: str, column: str) -> DataFrame:
    """Add ``problems`` (list) and ``conforms`` for documents of ``kind``."""
    return df.withColumn("problems", PROBLEMS[kind](column)).withColumn("conforms", F.size("problems") == 0)


def _common(old: Sequence, new: Sequence, weight) -> list[tuple[int, int]]:
    """Pairs of places of the alignment of highest total weight that keeps the order; pairs of weight 0 are left out."""
    best = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    gains = [[weight(o, n) for n in new] for o in old]
    for i in range(len(old) - 1, -1, -1):
        for j in range(len(new) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + gains[i][j])
    pairs, i, j = [], 0, 0
    while i < len(old) and j < len(new):
        if gains[i][j] and best[i][j] == best[i + 1][j + 1] + gains[i][j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return pairs


def _list_changes(section: str, prefix: str, old: Sequence[str], new: Sequence[str]):
    """Changes of a list of texts: equal texts are anchors in order; what lies between two anchors is paired in order."""
    anchors = _common(old, new, lambda a, b: int(a == b))
    i = j = 0
    for a, b in [*anchors, (len(old), len(new))]:
        for k in range(max(a - i, b - j)):
            before = old[i + k] if i + k < a else None
            after = new[j + k] if j + k < b else None
            action = "add" if i + k >= a else "remove" if j + k >= b else "update"
            yield section, f"{prefix}{i + k if after is None else j + k}", action, before, after
        i, j = a + 1, b + 1


def _aligned(old: Sequence[dict], new: Sequence[dict], names: Sequence[str], weight) -> list[tuple[int, int]]:
    """Pairs of equal names first, wherever they stand, then the others in order by weight."""
    places: dict[tuple, list[int]] = {}
    for j, n in enumerate(new):
        places.setdefault(tuple(n[c] for c in names), []).append(j)
    pairs = []
    for i, o in enumerate(old):
        at = places.get(tuple(o[c] for c in names))
        if at:
            pairs.append((i, at.pop(0)))
    left = [i for i in range(len(old)) if i not in {a for a, _ in pairs}]
    free = [j for j in range(len(new)) if j not in {b for _, b in pairs}]
    more = _common([old[i] for i in left], [new[j] for j in free], weight)
    return sorted(pairs + [(left[i], free[j]) for i, j in more])


def _shared(a: dict, b: dict) -> int:
    """How alike two roles are: bullets in common count twice, an equal title or company once."""
    bullets = len(set(a["achievements"] or ()) & set(b["achievements"] or ()))
    return 2 * bullets + sum(a[c] is not None and a[c] == b[c] for c in ("title", "company"))


def _role_changes(old: Sequence[dict], new: Sequence[dict]):
    pairs = _aligned(old, new, ("title", "company"), _shared)
    in_order = {pairs[i][0] for i, _ in _common(pairs, sorted(j for _, j in pairs), lambda p, j: int(p[1] == j))}
    for i, j in pairs:
        if i not in in_order:
            yield "role", str(j), "move", str(i), new[j]["title"]
        for c in ("title", "company", "startDate", "endDate"):
            if old[i][c] != new[j][c]:
                yield "role", f"{j}.{c}", "update", old[i][c], new[j][c]
        yield from _list_changes("experience", f"{j}.", old[i]["achievements"] or (), new[j]["achievements"] or ())
    for i, role in enumerate(old):
        if i not in {a for a, _ in pairs}:
            yield "role", str(i), "remove", role["title"], None
            yield from _list_changes("experience", f"{i}.", role["achievements"] or (), ())
    for j, role in enumerate(new):
        if j not in {b for _, b in pairs}:
            yield "role", str(j), "add", None, role["title"]
            yield from _list_changes("experience", f"{j}.", (), role["achievements"] or ())


def _project_changes(old: Sequence[dict], new: Sequence[dict]):
    pairs = _aligned(old, new, ("name",), lambda a, b: int(a["description"] is not None and a["description"] == b["description"]))
    for i, j in pairs:
        for c in ("name", "description"):
            if old[i][c] != new[j][c]:
                yield "projects", f"{j}.{c}", "update", old[i][c], new[j][c]
    for i, project in enumerate(old):
        if i not in {a for a, _ in pairs}:
            yield "projects", str(i), "remove", project["name"], None
    for j, project in enumerate(new):
        if j not in {b for _, b in pairs}:
            yield "projects", str(j), "add", None, project["name"]


def changes_of(old: dict | None, new: dict | None):
    """(section, slot, action, before, detail) of one resume and its new version."""
    old, new = old or {}, new or {}
    before, after = old.get("summary") or "", new.get("summary") or ""
    if before != after:
        yield "summary", "0", "update", before, after
    for section in ("skills", "education"):
        yield from _list_changes(section, "", old.get(section) or (), new.get(section) or ())
    yield from _role_changes(old.get("experience") or (), new.get("experience") or ())
    yield from _project_changes(old.get("projects") or (), new.get("projects") or ())


_CHANGE = ("section", "slot", "action", "before", "detail")


def resume_changes(df: DataFrame, before: Column | str, after: Column | str, keys: Sequence[str]) -> DataFrame:
    """(keys, section, slot, action, before, detail) of rows that hold both versions of a resume. Nothing is shuffled.

    Roles meet by title and company, the others in order by what they share; bullets, skills and education are aligned by
    equal texts in order, and projects by name. ``slot`` is the place in the new version, of removed items in
    the old one. Actions are add, update, remove, and move for a role that left its order (of two that changed places,
    the first of the old version).
    """
    keys = list(keys)
    parts = ("summary", "skills", "education", "experience", "projects")

    def compared(c):
        c = X.col(c)
        return F.when(c.isNotNull(), F.struct(*[c[p].alias(p) for p in parts]))

    rows = df.select(*keys, compared(before).alias("_before"), compared(after).alias("_after"))
    schema = T.StructType([*[rows.schema[k] for k in keys], *[T.StructField(c, T.StringType()) for c in _CHANGE]])
    arrow = to_arrow_schema(schema)

    def compare(batches):
        for batch in batches:
            found: list[list] = [[] for _ in schema]
            *key_columns, old, new = [c.to_pylist() for c in batch.columns]
            for at, (a, b) in enumerate(zip(old, new)):
                for change in changes_of(a, b):
                    for column, value in zip(found, (*[k[at] for k in key_columns], *change)):
                        column.append(value)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(found, arrow)], schema=arrow)

    return rows.mapInArrow(compare, schema)


def resume_diff(base: DataFrame, tailored: DataFrame, keys: Sequence[str], resume: str = "resume") -> DataFrame:
    """``resume_changes`` of two tables that meet by their keys; a resume on one side only is added or removed whole."""
    keys = list(keys)
    old, new = (df.select(*keys, F.col(resume).alias(name)) for df, name in ((base, "_old"), (tailored, "_new")))
    return resume_changes(old.join(new, keys, "full_outer"), "_old", "_new", keys)
