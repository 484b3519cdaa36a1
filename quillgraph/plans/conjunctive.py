"""Conjunctive graph patterns: several links of a question that share variables, matched together.

links: qid, ord, source, target (variables), type, src_label, dst_label. held: qid, var, element_id: the nodes that a variable may
stand for, of which there may be several; a variable without rows is free, unless ``required`` (qid, var) names it: then the question has no
rows. edges: type, src_label, src_id, dst_label, dst_id.

Each question's links become connected parts, and each part a walk from its first held variable, or else its first one: a step for each
link that reaches a new variable, and checks for the others. Parts of one shape whose variables are held to the same nodes have the same rows,
whatever questions ask them, so they are matched once. All parts are matched at once, so the number of joins follows the longest walk and not the number of shapes.
What a step does depends on the shape alone, which a part's ``pid`` begins with. Shapes are few, so they are broadcast: rows of one part, which may be as many as all edges, are never
brought together by it.

1. forward, the edges of each step start from the nodes that the steps before have reached, and end in what is held: there by both ends. Where
   nothing hangs on the new variable, only a node's first ``limit`` edges by the other end can be in the first rows, and no others are read;
2. backward, from the leaves, each step keeps the edges that every later step on it can continue;
3. then every partial row of a part without cycles leads to a whole one, so the first ``limit`` rows by the ids along the walk follow from
   the first ``limit`` partial rows of each step; Spark bounds them before the shuffle too, so a hub's edges never meet in one task.
   With a cycle, rows are bounded after its last check.

Parts of one question are combined after each has its first rows. One edge may serve two links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.cut import discarded, kept

ROW_LIMIT = 10
#: Questions of one part that meet its rows in one task.
QUESTIONS = 4096
#: So many shapes are broadcast; more are joined as any table.
SHAPES = 4096
RULE = ["type", "src_label", "dst_label"]
_RULE = "type:string,src_label:string,dst_label:string"
STEP = f"struct<step:int,known:int,new:int,forward:boolean,{_RULE},is_held:boolean,last:boolean,later:array<int>>"
CHECK = f"struct<step:int,known:int,new:int,{_RULE}>"
BESIDE = f"struct<step:int,along:boolean,{_RULE}>"


def walk(links: list[dict], held: set[str]) -> list[dict]:
    """The parts of a question's links: names (variables in the order of the walk), free, steps and checks.

    A check is a link between variables that were reached before; it belongs to the step that reached the later one (0: the root alone).
    """
    links = sorted(links, key=lambda x: x["ord"])
    variables = list(dict.fromkeys(v for x in links for v in (x["source"], x["target"])))
    parts, left = [], list(links)
    while left:
        here = next((v for v in variables if v in held and any(v in (x["source"], x["target"]) for x in left)), left[0]["source"])
        names, reached_at, steps, checks = [here], {here: 0}, [], []
        at = 0
        while at < len(names):
            for x in [x for x in left if names[at] in (x["source"], x["target"])]:
                left.remove(x)
                forward = x["source"] == names[at]
                other = x["target"] if forward else x["source"]
                rule = {k: x[k] for k in RULE}
                if other in reached_at:
                    checks.append({"step": max(reached_at[names[at]], reached_at[other]), "known": names.index(x["source"]), "new": names.index(x["target"]), "forward": True, **rule})
                else:
                    reached_at[other] = len(steps) + 1
                    steps.append({"step": len(steps) + 1, "known": at, "new": len(names), "forward": forward, **rule})
                    names.append(other)
            at += 1
        parts.append({"names": names, "free": not held & set(names), "steps": steps, "checks": checks})
    return parts


def shape(part: dict, held: set[str]) -> dict:
    """What a part's walk asks of any nodes: free, steps, later, checks and beside.

    A step tells whether its new variable is held (``is_held``), whether neither a step nor a check hangs on it (``last``), and which steps do (``later``; of the root, that of the part).
    A check between the ends of a step is ``beside`` it, and ``along`` says whether it goes the step's way.
    """
    later = lambda n: [s["step"] for s in part["steps"] if s["known"] == n]
    bound = {n for c in part["checks"] for n in (c["known"], c["new"])}
    steps = [{**s, "is_held": part["names"][s["new"]] in held, "last": not later(s["new"]) and s["new"] not in bound, "later": later(s["new"])} for s in part["steps"]]
    checks, beside = [], []
    for c in part["checks"]:
        rule = {k: c[k] for k in RULE}
        step = next((s for s in part["steps"] if {s["known"], s["new"]} == {c["known"], c["new"]}), None)
        if step is None:
            checks.append({"step": c["step"], "known": c["known"], "new": c["new"], **rule})
        else:
            beside.append({"step": step["step"], "along": c["known"] == step["known"], **rule})
    return {"free": part["free"], "steps": steps, "later": later(0), "checks": checks, "beside": beside}


def planned(links: DataFrame, held: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """qid, part, pid (binary), names, and what ``shape`` gives: a row for each connected part of a question's links."""
    own = held.groupBy("qid", "var").agg(_digest("element_id").alias("nodes")).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("var", "nodes"))).alias("held"))  # variables of one question
    if required is not None:
        missing = required.select("qid", "var").distinct().join(held.select("qid", "var").distinct(), ["qid", "var"], "left_anti")
        links = links.join(missing.select("qid").distinct(), "qid", "left_anti")
    each = F.struct("ord", "source", "target", *RULE)
    asked = links.groupBy("qid").agg(F.sort_array(F.collect_set(each)).alias("links")).join(own, "qid", "left")
    columns = ["free", "steps", "later", "checks", "beside"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for qid, links, held in zip(batch["qid"], batch["links"], batch["held"], strict=True):
                nodes = dict(held) if held is not None else {}
                parts = walk([x if isinstance(x, dict) else x.asDict() for x in links], set(nodes))
                for i, p in enumerate(parts):
                    told = shape(p, set(nodes))
                    rows.append((qid, i, p["names"], [nodes.get(v) for v in p["names"]], *(told[c] for c in columns)))
            yield pd.DataFrame(rows, columns=["qid", "part", "names", "nodes", *columns])

    kind = links.schema["qid"].dataType.simpleString()
    found = asked.mapInPandas(run, f"qid {kind}, part int, names array<string>, nodes array<string>, free boolean, steps array<{STEP}>, later array<int>, checks array<{CHECK}>, beside array<{BESIDE}>")
    digest = lambda size, *cs: F.substring(F.unhex(F.sha2(F.to_json(F.struct(*cs)), 256)), 1, size)
    return found.withColumn("pid", F.concat(digest(8, *columns), digest(16, "nodes"))).drop("nodes")


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("shape", F.substring("pid", 1, 8))


def _digest(c: str) -> Column:
    """A text that tells sets of distinct values apart: their number, and four sums over parts of their hashes, in whatever order."""
    hashed = F.sha2(F.col(c).cast("string"), 256)
    sums = (F.sum(F.conv(F.substring(hashed, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4))
    return F.concat_ws("/", F.count("*").cast("string"), *sums)


def _ends(edges: DataFrame, steps: DataFrame, ways: set[bool]) -> DataFrame:
    """forward, rule, known_id, new_id: the edges of the steps' rules, in their ``ways``."""
    near = lambda f: ("src_id", "dst_id") if f else ("dst_id", "src_id")
    out = [edges.select(F.lit(f).alias("forward"), *RULE, *(F.col(c).alias(n) for c, n in zip(near(f), ("known_id", "new_id"), strict=True))) for f in sorted(ways)]
    rules = steps.select("forward", *RULE).distinct()
    return reduce(DataFrame.union, out).join(F.broadcast(rules), ["forward", *RULE], "left_semi")  # a row per rule of the schema


def _first_edges(ends: DataFrame, limit: int) -> DataFrame:
    """Each node's first ``limit`` edges by the other end, of each rule and way."""
    rank = F.dense_rank().over(Window.partitionBy("forward", *RULE, "known_id").orderBy("new_id"))
    return ends.withColumn("n", rank).where(F.col("n") <= limit).drop("n")


def _edges_of(asked: DataFrame, ends: DataFrame, domain: DataFrame, first: DataFrame | None, forms: set[tuple[bool, bool]], free: DataFrame | None = None) -> DataFrame:
    """Edges that continue ``asked`` by its rule, in its direction: pid, known, new, known_id, new_id.

    ``asked`` says whether the new variable is held (``is_held``), to what ``domain`` (pid, new, new_id) has, and whether it is an end (``last``); ``first`` has the edges for those.
    ``forms`` are the pairs of both that are met. ``free`` starts from anywhere: it has no known_id, and a row per shape at most.
    """
    columns = ["pid", "known", "new", "known_id", "new_id"]
    key = ["forward", *RULE, "known_id"]
    out = []
    if (False, True) in forms:
        out.append(asked.where("NOT is_held AND last").join(first, key))
    if any(is_held for is_held, _ in forms):
        # Both ends are known, so a hub's other edges aren't read.
        out.append(asked.where("is_held").join(domain, ["pid", "new"]).join(ends, [*key, "new_id"], "left_semi"))
    if (False, False) in forms:
        out.append(asked.where("NOT is_held AND NOT last").join(ends, key))
    if free is not None:
        out.append(ends.join(free, ["forward", *RULE]))
    return reduce(DataFrame.union, [x.select(columns) for x in out]).distinct()


def _checked(rows: DataFrame, checks: DataFrame, edges: DataFrame, source: Column, target: Column, names: list[str], small) -> DataFrame:
    """Rows (with pid) whose ends are joined by an edge of every one of their ``checks`` (shape, rule); rows without checks pass."""
    edge = edges.select(*(F.col(c).alias(f"e_{c}") for c in (*RULE, "src_id", "dst_id"))).distinct()
    number = checks.groupBy("shape").agg(F.count("*").alias("n_checks"))
    marked = _shaped(rows).join(small(number), "shape", "left")
    rest = marked.where("n_checks IS NULL").select(names)
    ask = marked.where("n_checks IS NOT NULL").withColumn("row_key", F.to_json(F.struct(*names))).join(small(checks), "shape")
    rule = [F.col(c) == F.col(f"e_{c}") for c in RULE]
    ok = ask.join(edge, [*rule, source == F.col("e_src_id"), target == F.col("e_dst_id")], "left_semi")
    whole = ok.groupBy("row_key", "n_checks").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in names)).where("n = n_checks")
    return rest.unionByName(whole.select(names))


def _first_rows(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows of each part by ids."""
    rank = F.row_number().over(Window.partitionBy("pid").orderBy("ids"))
    return rows.withColumn("n", rank).where(F.col("n") <= limit).drop("n")


def _numbers(shapes: DataFrame) -> dict:
    """Of all shapes: their number, the shortest and the longest walk, and which numbers of steps and variables are met."""
    each = lambda c, f: F.array_distinct(F.flatten(F.collect_set(F.transform(c, f)))).alias(c)
    hangs = F.concat(F.transform("later", lambda x: F.array(F.lit(0), x)), F.flatten(F.transform("steps", lambda s: F.transform(s["later"], lambda x: F.array(s["step"], x)))))
    row = shapes.agg(
        F.count("*").alias("n"), F.min(F.size("steps")).alias("shortest"), F.max(F.size("steps")).alias("longest"), F.max("free").alias("free"),
        each("steps", lambda s: F.struct(s["step"], s["forward"], s["is_held"], s["last"])), each("checks", lambda c: F.struct(c["step"], c["known"], c["new"])),
        each("beside", lambda b: F.struct(b["step"], b["along"])), F.array_distinct(F.flatten(F.collect_set(hangs))).alias("hangs"),
    ).first()
    return row.asDict() | {c: {tuple(x) for x in row[c] or ()} for c in ("steps", "checks", "beside", "hangs")}


def matched(links: DataFrame, held: DataFrame, edges: DataFrame, required: DataFrame | None = None, limit: int = ROW_LIMIT) -> DataFrame:
    """qid, ord, ids (map from variable to node): the first ``limit`` rows of each question that meet all its links; a written table."""
    held = held.select("qid", "var", "element_id").where("element_id IS NOT NULL").distinct()
    plan = kept(planned(links, held, required))
    used = [plan]

    def hold(df: DataFrame) -> DataFrame:
        used.append(made := kept(df))
        return made

    shapes = hold(_shaped(plan).select("shape", "free", "steps", "later", "checks", "beside").dropDuplicates(["shape"]))
    met_numbers = _numbers(shapes)
    longest, cycles = met_numbers["longest"], met_numbers["checks"]
    if longest is None:  # no links
        none = kept(plan.select("qid", F.lit(1).alias("ord"), F.map_from_arrays("names", "names").alias("ids")).where("false"))
        discarded(*used)
        return none
    small = F.broadcast if met_numbers["n"] <= SHAPES else lambda df: df
    steps = shapes.select("shape", F.inline("steps"))
    checks = shapes.select("shape", F.inline("checks"))
    beside = shapes.select("shape", F.inline("beside"))
    numbers = plan.where("NOT free").select("qid", "pid", F.posexplode("names").alias("new", "var")).join(held, ["qid", "var"])
    domain = hold(numbers.select("pid", "new", F.col("element_id").alias("new_id")).distinct())  # what each variable is held to, by number

    # Forward. The root is the new variable of step 0.
    ways = lambda some: {f for _, f, *_ in some}
    ended = {x for x in met_numbers["steps"] if not x[2] and x[3]}
    first_edges = hold(_first_edges(_ends(edges, steps.where("last AND NOT is_held"), ways(ended)), limit)) if ended else None
    frontier = domain.where("new = 0").select("pid", F.col("new").alias("known"), F.col("new_id").alias("known_id"))
    met: dict[int, DataFrame] = {}
    for s in range(1, longest + 1):
        here, some = steps.where(F.col("step") == s).drop("step", "later"), {x for x in met_numbers["steps"] if x[0] == s}
        if s == 1:
            reached = frontier
        else:
            from_step = [met[e].select("pid", F.col("new").alias("known"), F.col("new_id").alias("known_id")) for e in range(1, s) if (e, s) in met_numbers["hangs"]]
            from_root = [met[1].select("pid", "known", "known_id")] if (0, s) in met_numbers["hangs"] else []
            reached = reduce(DataFrame.union, from_step + from_root).distinct()
        ask = _shaped(reached).join(small(here), ["shape", "known"]).drop("shape")
        free = None
        if s == 1 and met_numbers["free"]:
            anywhere = _shaped(plan.where("free").select("pid").distinct())
            free = small(anywhere.join(small(here), "shape").select("pid", "known", "new", "forward", *RULE))
        found = _edges_of(ask, _ends(edges, here, ways(some)), domain, first_edges, {x[2:] for x in some}, free)
        for along in (x[1] for x in met_numbers["beside"] if x[0] == s):
            ask_beside = beside.where((F.col("step") == s) & (F.col("along") == along)).select("shape", *RULE)
            ends = ("known_id", "new_id") if along else ("new_id", "known_id")
            found = _checked(found, ask_beside, edges, F.col(ends[0]), F.col(ends[1]), ["pid", "known", "new", "known_id", "new_id"], small)
        met[s] = hold(found)

    # Backward.
    def live(rows: DataFrame, later: DataFrame, s: int) -> DataFrame:
        """Rows (pid, new_id) of the shapes that ``later`` (shape) has, if step ``s`` goes on from them; others stay."""
        goes_on = met[s].select("pid", F.col("known_id").alias("new_id")).distinct().withColumn("live", F.lit(True))
        marked = _shaped(rows).join(small(later.select("shape", F.lit(True).alias("asks"))), "shape", "left").join(goes_on, ["pid", "new_id"], "left")
        return marked.where("asks IS NULL OR live").select(rows.columns)

    for s in range(longest, 0, -1):
        later = [x for e, x in met_numbers["hangs"] if e == s]
        for x in sorted(later, reverse=True):
            met[s] = live(met[s], steps.where((F.col("step") == s) & F.array_contains("later", x)), x)
        met[s] = hold(met[s]) if later else met[s]
    none = plan.select("pid", F.lit(None).cast("string").alias("new_id")).where("false")
    roots = met[1].select("pid", F.col("known_id").alias("new_id")).distinct() if longest else none
    for x in sorted(x for e, x in met_numbers["hangs"] if e == 0 and x > 1):
        roots = live(roots, shapes.where(F.array_contains("later", x)), x)
    if met_numbers["shortest"] == 0:  # links from a variable to itself, and no others: the checks are made below
        alone = plan.where("size(steps) = 0").select("pid", "free", F.inline(F.slice("checks", 1, 1))).select("pid", "free", *RULE).distinct()
        loops = edges.where("src_id = dst_id").select(*RULE, F.col("src_id").alias("new_id")).distinct()
        roots = roots.unionByName(alone.where("NOT free").select("pid").join(frontier.select("pid", F.col("known_id").alias("new_id")), "pid")).unionByName(loops.join(small(alone.where("free")), RULE).select("pid", "new_id"))

    def with_checks(rows: DataFrame, s: int) -> DataFrame:
        for _, a, b in sorted(k for k in cycles if k[0] == s):
            here = checks.where((F.col("step") == s) & (F.col("known") == a) & (F.col("new") == b)).select("shape", *RULE)
            rows = _checked(rows, here, edges, F.get("ids", F.lit(a)), F.get("ids", F.lit(b)), ["pid", "ids"], small)
        if not any(k[0] > s for k in cycles):
            return hold(_first_rows(rows, limit))
        open_ones = shapes.where(F.exists("checks", lambda c: c["step"] > s)).select("shape")  # of these, rows may still be left out
        rows = _shaped(rows)
        closed = _first_rows(rows.join(small(open_ones), "shape", "left_anti"), limit)
        return hold(rows.join(small(open_ones), "shape", "left_semi").unionByName(closed).drop("shape"))

    rows = with_checks(roots.select("pid", F.array("new_id").alias("ids")), 0)
    done = []
    for s in range(1, longest + 1):
        if met_numbers["shortest"] < s:
            done.append(_shaped(rows).join(small(shapes.where(F.size("steps") == s - 1).select("shape")), "shape", "left_semi").drop("shape"))
        ends = _shaped(rows).join(small(steps.where(F.col("step") == s).select("shape", "known")), "shape").select("pid", "ids", "known", F.get("ids", F.col("known")).alias("known_id"))
        rows = ends.join(met[s].select("pid", "known", "known_id", "new_id"), ["pid", "known", "known_id"]).select("pid", F.array_append("ids", F.col("new_id")).alias("ids"))
        rows = with_checks(rows, s)
    rows = hold(reduce(DataFrame.union, [rows, *done])) if done else rows

    # The parts of a question side by side; each has at most ``limit`` rows. A part that many questions share goes to several tasks.
    shared = plan.groupBy("pid").agg(F.ceil(F.count("*") / QUESTIONS).alias("tasks")).where("tasks > 1")  # one in QUESTIONS at most
    tasks = F.coalesce("tasks", F.lit(1).cast("long"))
    plan_by_task = plan.join(F.broadcast(shared), "pid", "left").withColumn("task", F.pmod(F.xxhash64("qid"), tasks))
    rows = rows.join(F.broadcast(shared), "pid", "left").select("pid", "ids", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)).alias("task"))
    most = plan.agg(F.max("part")).first()[0]
    number = plan.groupBy("qid").agg(F.max("part").alias("last"))
    out = None
    for p in range(most + 1):
        here = plan_by_task.where(F.col("part") == p).select("qid", "pid", "names", "task").join(rows, ["pid", "task"]).select("qid", F.map_from_arrays("names", "ids").alias("more"), F.col("ids").alias("more_ids"))
        if out is None:
            both = here.select("qid", F.col("more").alias("ids"), F.col("more_ids").alias("order"))
        else:
            single = out.join(number.where(F.col("last") < p), "qid", "left_semi")
            both = single.unionByName(out.join(here, "qid").select("qid", F.map_concat("ids", "more").alias("ids"), F.concat("order", "more_ids").alias("order")))
        rank = F.row_number().over(Window.partitionBy("qid").orderBy("order"))
        out = both.withColumn("ord", rank).where(F.col("ord") <= limit).drop("ord")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("order"))
    result = kept(out.select("qid", rank.alias("ord"), "ids"))
    discarded(*used)
    return result


def pattern_edges(rows: DataFrame, links: DataFrame) -> DataFrame:
    """qid, ord, link, type, src_label, src_id, dst_label, dst_id: the edges of each row of ``matched``."""
    each = links.select("qid", F.col("ord").alias("link"), "source", "target", *RULE)
    joined = rows.join(each, "qid")
    return joined.select("qid", "ord", "link", "type", "src_label", F.try_element_at("ids", F.col("source")).alias("src_id"), "dst_label", F.try_element_at("ids", F.col("target")).alias("dst_id"))
