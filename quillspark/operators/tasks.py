"""Tasks: the filter language as columns, project trees, references, histories."""

import re
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import free
from ..session import cut, written


def due_filter(text: str, today: date, due: str = "due_date") -> Column | None:
    """A date predicate as a Column, or None where the text is none. Tasks without a date match ``no date`` only."""
    t, day, when = text.strip().lower(), F.lit(today), F.col(due)
    simple = {
        "today": when == day, "tomorrow": when == F.date_add(day, 1), "overdue": when < day, "no date": when.isNull(), "no due date": when.isNull(), "recurring": F.col("is_recurring"),
        "next week": (when >= F.next_day(day, "Mon")) & (when < F.date_add(F.next_day(day, "Mon"), 7)),
    }
    if t in simple:
        return F.coalesce(simple[t], F.lit(False))
    if m := re.fullmatch(r"(\d+) days?", t):
        return F.coalesce((when >= day) & (when < F.date_add(day, int(m[1]))), F.lit(False))
    if m := re.fullmatch(r"(due|created)(?: (before|after|on))?: ?(.+)", t):
        value, side = m[3].strip(), F.to_date("created_at") if m[1] == "created" else when
        if n := re.fullmatch(r"([+-]?\d+) days?", value):
            at = F.date_add(day, int(n[1]))
        elif value in ("today", "tomorrow", "yesterday"):
            at = F.date_add(day, {"today": 0, "tomorrow": 1, "yesterday": -1}[value])
        else:
            at = F.lit(date.fromisoformat(value))
        return F.coalesce({"before": side < at, "after": side > at}.get(m[2], side == at), F.lit(False))
    return None


def field_filter(text: str, me: int | None = None) -> Column | None:
    """A predicate on priority, label, project, section or assignee, without regard to case; None where the text is none."""
    t = text.strip()
    low = t.lower()
    same = lambda c, v: F.coalesce(F.lower(c) == v, F.lit(False))
    person = lambda v: F.lit(me) if v == "me" else F.lit(v).try_cast("long")
    if re.fullmatch("p[1-4]", low):
        return F.coalesce(F.col("priority") == int(low[1]), F.lit(False))
    if low in ("no priority", "no labels", "assigned"):
        return {"no priority": F.coalesce(F.col("priority") == 4, F.lit(False)), "no labels": F.coalesce(F.size("labels") == 0, F.lit(True)), "assigned": F.col("assignee_id").isNotNull()}[low]
    if low.startswith("@"):
        return F.coalesce(F.exists("labels", lambda x: F.lower(x) == low[1:]), F.lit(False))
    if low.startswith("##"):
        return None
    if low.startswith("#"):
        return same("project", low[1:])
    if low.startswith("/"):
        return same("section", low[1:])
    if m := re.fullmatch(r"assigned (to|by): ?(.+)", low):
        return F.coalesce(F.col("assignee_id" if m[1] == "to" else "assigned_by_id") == person(m[2]), F.lit(False))
    return None


def filter_column(expression: str, today: date, me: int | None = None, subtree=None) -> Column:
    """An expression with ! before & before | and brackets, as one Column; names may be quoted. subtree: from a project's name to a Column, for ##."""
    parts = re.findall(r'"[^"]*"|[&|!()]|(?:\\.|"[^"]*"|[^&|!()"])+', expression)
    parts = [p.strip() for p in parts if p.strip()]

    def take(level: int) -> Column:
        if level < 2:
            left = take(level + 1)
            while parts and parts[0] == "|&"[level]:
                parts.pop(0)
                right = take(level + 1)
                left = left | right if level == 0 else left & right
            return left
        token = parts.pop(0) if parts else ""
        if token == "!":
            return ~take(2)
        if token == "(":
            inside = take(0)
            if not parts or parts.pop(0) != ")":
                raise ValueError("a bracket is not closed")
            return inside
        text = token.replace('"', "")
        if text.startswith("##") and subtree is not None:
            return subtree(text[2:].strip())
        for found in (due_filter(text, today), field_filter(text, me)):
            if found is not None:
                return found
        raise ValueError(f"not a filter: {text!r}")

    out = take(0)
    if parts:
        raise ValueError(f"not understood from {parts[0]!r} on")
    return out


def project_subtree(projects: DataFrame, root: str) -> DataFrame:
    """project_id of the projects with that name and all below them, however deep.

    Every project points to its parent; in each round pointers are doubled, and a project that points to a found one is
    found. After k rounds all within 2^k - 1 levels are known, and as the levels of a tree follow each other, a round that
    finds nothing is the last. So a chain of n levels takes about log2(n) rounds, each of which ends in files, and a cycle
    ends as a chain does. A project with two parents is below both; null ids are no projects, and null parents none.
    """
    found = written(projects.where(F.lower("name") == root.lower()).where("project_id is not null").select("project_id").distinct())
    up = projects.where("project_id is not null and parent_id is not null and project_id <> parent_id").select("project_id", "parent_id").distinct()
    up = written(up.join(found, "project_id", "left_anti"))
    while True:
        new = written(up.join(found.withColumnRenamed("project_id", "parent_id"), "parent_id", "left_semi").select("project_id").distinct())
        if new.isEmpty():
            return found
        found = written(found.unionByName(new))
        # Whoever is found needs no pointer any more; whoever has come to a root's end without being found never will be.
        above = up.select(F.col("project_id").alias("parent_id"), F.col("parent_id").alias("above"))
        up = written(up.join(new, "project_id", "left_anti").join(above, "parent_id").select("project_id", F.col("above").alias("parent_id")).distinct())


def filter_tasks(tasks: DataFrame, expression: str, today: date, me: int | None = None, projects: DataFrame | None = None) -> DataFrame:
    """The tasks that match. A ## name becomes a flag from a join to the project's tree; the names of projects are joined for #."""
    names = re.findall(r'##\s*("[^"]*"|[^&|!()"]+)', expression)
    out, flags = tasks, {}
    if projects is not None:
        out = out.drop("project").join(projects.select("project_id", F.col("name").alias("project")), "project_id", "left")
        for name in dict.fromkeys(n.replace('"', "").strip() for n in names):
            (flags[name],) = free(out, "in_tree")
            out = out.join(project_subtree(projects, name).withColumn(flags[name], F.lit(True)), "project_id", "left")
    chosen = filter_column(expression, today, me, lambda name: F.coalesce(F.col(flags[name]), F.lit(False)))
    return out.where(chosen).drop(*flags.values()).select(*tasks.columns)


#: Letters of the parts by which references find names.
GRAM = 3


def _grams(text: F.Column, n: int) -> F.Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))


def containing(refs: DataFrame, things: DataFrame) -> DataFrame:
    """ref, id and name of the names that contain a reference, in any case of letters.

    Names are indexed by their parts of 1 to GRAM letters, and a reference looks up one part of its own: the one
    that the fewest names have. So it meets the names with that part, not all names.
    """
    names = things.select("id", "name", F.lower("name").alias("low"))
    lists = F.array_distinct(F.concat(*(_grams(F.col("low"), n) for n in range(1, GRAM + 1))))
    index = cut(names.select("id", "name", "low", F.explode(lists).alias("gram")))
    low = F.lower("ref")
    own = refs.select("ref", low.alias("wanted"), F.explode(F.when(F.length(low) >= GRAM, _grams(low, GRAM)).otherwise(F.array(low))).alias("gram"))
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(counts, "gram", "left").groupBy("ref", "wanted").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return cut(rarest).join(index, "gram").where(F.contains("low", F.col("wanted"))).select("ref", "id", "name")


def resolve_refs(refs: DataFrame, resources: DataFrame) -> DataFrame:
    """ref, match, id, name, ambiguous: all candidates of the best class (id, then exact name, then part of a name).

    All three are equi-joins; only references without an id or a name look for parts of names.
    """
    wanted = refs.select("ref").distinct().withColumn("wanted_id", F.coalesce(F.nullif(F.regexp_extract("ref", "^id:(.*)$", 1), F.lit("")), F.col("ref"))).withColumn("only_id", F.col("ref").startswith("id:"))
    things = resources.select(F.col("id").cast("string").alias("id"), "name")
    by_id = wanted.join(things, F.col("wanted_id") == F.col("id")).select("ref", F.lit("id").alias("match"), "id", "name")
    left = wanted.where(~F.col("only_id")).join(by_id.select("ref"), "ref", "left_anti")
    by_name = left.join(things, F.lower("ref") == F.lower("name")).select("ref", F.lit("name").alias("match"), "id", "name")
    rest = left.join(by_name.select("ref"), "ref", "left_anti").where("ref <> ''")
    by_part = containing(rest, things).select("ref", F.lit("part").alias("match"), "id", "name")
    found = by_id.unionByName(by_name).unionByName(by_part)
    return found.withColumn("ambiguous", F.count("*").over(Window.partitionBy("ref")) > 1)


def completed_between(tasks: DataFrame, since: str, until: str, project: int | None = None, by: str = "completion") -> DataFrame:
    """Completed tasks with completion (or due date) in [since, until)."""
    side = F.col("completed_at") if by == "completion" else F.col("due_date").cast("timestamp")
    rows = tasks.where(F.col("completed_at").isNotNull() & (side >= F.lit(since).cast("timestamp")) & (side < F.lit(until).cast("timestamp")))
    return rows if project is None else rows.where(F.col("project_id") == project)


def completed_page(tasks: DataFrame, limit: int = 300, cursor: tuple[str, int] | None = None) -> DataFrame:
    """The newest completed tasks, after the cursor (completion, id) of the page before."""
    rows = tasks.where("completed_at is not null")
    if cursor:
        at, key = F.lit(cursor[0]).cast("timestamp"), F.lit(cursor[1])
        rows = rows.where((F.col("completed_at") < at) | ((F.col("completed_at") == at) & (F.col("task_id") < key)))
    return rows.orderBy(F.desc("completed_at"), F.desc("task_id")).limit(limit)


def completed_stats(tasks: DataFrame) -> DataFrame:
    """Completed tasks by day and project, with totals (level: grouping_id of day and project)."""
    rows = tasks.where("completed_at is not null").select(F.to_date("completed_at").alias("day"), "project_id")
    return rows.cube("day", "project_id").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def upcoming(tasks: DataFrame, days: int, today: date) -> DataFrame:
    return tasks.where(due_filter(f"{days} days", today)).orderBy("due_date", "priority", "task_id")
