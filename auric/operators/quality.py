"""Constraints as data-quality jobs.

PostgreSQL rejects a bad row at write time; here a job reports every violation
of a whole table as ``(table, rule, key, value)`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import TABLES

VIOLATION_COLS = ("table_name", "rule", "row_key", "value")


def _key(key_cols) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])


def _violations(df: DataFrame, table: str, key_cols, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """All rule checks in one scan; a row explodes into the rules it breaks."""
    arr = F.array(*[F.when(bad, F.struct(F.lit(r).alias("rule"), v.cast("string").alias("value")))
                    for r, v, bad in checks]).cast("array<struct<rule:string,value:string>>")
    return (df.select(_key(key_cols).alias("row_key"), F.explode(F.array_compact(arr)).alias("c"))
              .select(F.lit(table).alias("table_name"), F.col("c.rule").alias("rule"), "row_key",
                      F.col("c.value").alias("value")))


# --------------------------------------------------------------------- V-01
def check_domain(df: DataFrame, table: str, key_cols, rules: dict) -> DataFrame:
    """``rules``: column → list of allowed values, or (low, high) inclusive.
    NULL passes, as under SQL three-valued logic."""
    checks = []
    for c, rule in rules.items():
        col = F.col(c)
        if isinstance(rule, tuple):
            ok = col.between(rule[0], rule[1])
            name = f"{c} between {rule[0]} and {rule[1]}"
        else:
            ok = col.isin(*rule)
            name = f"{c} in domain"
        checks.append((name, col, F.coalesce(~ok, F.lit(False))))
    return _violations(df, table, key_cols, checks)


DOMAIN_RULES = {name: t.checks for name, t in TABLES.items() if t.checks}


# --------------------------------------------------------------------- V-02
def check_not_null(df: DataFrame, table: str, key_cols, cols) -> DataFrame:
    return _violations(df, table, key_cols,
                       [(f"{c} not null", F.lit(None).cast("string"), F.col(c).isNull()) for c in cols])


# --------------------------------------------------------------------- V-03
def check_length(df: DataFrame, table: str, key_cols, limits: dict) -> DataFrame:
    return _violations(df, table, key_cols,
                       [(f"char_length({c}) <= {n}", F.col(c), F.coalesce(F.char_length(F.col(c)) > n, F.lit(False)))
                        for c, n in limits.items()])


# --------------------------------------------------------------------- V-04
#: Tasks among which keys are dealt, at least (``spark.sql.shuffle.partitions`` where that is
#: more). Up to 200 Spark writes each part straight to its file and buffers no rows.
KEY_TASKS = 200


def _dealt(df: DataFrame, *cols: str) -> DataFrame:
    """Rows dealt by key to a given number of tasks. AQE would join small parts of
    well packed keys into tasks whose unpacked keys are many times their size."""
    return df.repartition(max(KEY_TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *cols)


def check_unique(df: DataFrame, cols) -> DataFrame:
    """Duplicate keys with their multiplicity; NULL keys never collide.

    Nearly all keys are unique, so a partial aggregate before the shuffle would hold
    a row of a scan's task each and save nothing: the bare keys are dealt first and
    counted where they lie. A key that many rows have is one counter in its task."""
    cols = list(cols)
    keys = _dealt(df.dropna(subset=cols).select(*cols), *cols)
    return keys.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


# --------------------------------------------------------------------- V-05
def check_foreign_key(child: DataFrame, parent: DataFrame, child_key, parent_key) -> DataFrame:
    """Child rows whose key has no parent. Keys are a column or a list of
    columns; a key with a NULL part references nothing."""
    ck, pk = ([k] if isinstance(k, str) else list(k) for k in (child_key, parent_key))
    p = parent.select(*[F.col(b).alias(a) for a, b in zip(ck, pk)]).distinct()
    return child.dropna(subset=ck).join(p, ck, "left_anti")


def all_violations(df: DataFrame, table: str, key_cols) -> DataFrame:
    """V-01, V-02 and V-03 of a stored table for the columns ``df`` has, in one scan."""
    t, have = TABLES[table], set(df.columns)
    pick = lambda d: {c: v for c, v in d.items() if c in have}
    return (check_domain(df, table, key_cols, pick(t.checks))
            .unionByName(check_not_null(df, table, key_cols, [c for c in t.not_null if c in have]))
            .unionByName(check_length(df, table, key_cols, pick(t.lengths))))


# ------------------------------------------- V-01 … V-05 over all stored tables
RULE_COLS = ("table_name", "rule", "checked", "violations")


def _spark(tables: dict[str, DataFrame]):
    return next(iter(tables.values())).sparkSession


def _union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_rule_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """V-01, V-02 and V-03 as one row per (table, rule): rows checked and rows that
    break the rule, for every declared rule whose column is there. Each table is
    one scan and one aggregate without a group."""
    parts = []
    for name, df in tables.items():
        t, have = TABLES[name], set(df.columns)
        rules = [(f"{c} not null", F.lit(True), F.col(c).isNull()) for c in t.not_null if c in have]
        for c, allowed in t.checks.items():
            if c in have and isinstance(allowed, tuple):
                rules.append((f"{c} between {allowed[0]} and {allowed[1]}", F.col(c).isNotNull(), ~F.col(c).between(*allowed)))
            elif c in have:
                rules.append((f"{c} in domain", F.col(c).isNotNull(), ~F.col(c).isin(*allowed)))
        rules += [(f"char_length({c}) <= {n}", F.col(c).isNotNull(), F.char_length(F.col(c)) > n)
                  for c, n in t.lengths.items() if c in have]
        if rules:
            one = df.agg(*[F.struct(F.lit(name).alias("table_name"), F.lit(r).alias("rule"),
                                    F.count_if(there).alias("checked"), F.count_if(bad).alias("violations")).alias(f"r{i}")
                           for i, (r, there, bad) in enumerate(rules)])
            parts.append(one.select(F.explode(F.array(*one.columns)).alias("r")).select("r.*"))
    return _union_all(parts)


def unique_key_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """V-04 for every declared unique key: rows whose key is whole, and those beyond
    the first of their key. One scan per table; all keys share one shuffle, behind a
    partial aggregate, so a key that many rows have costs one row per task."""
    parts, rules = [], []
    for name, df in tables.items():
        keys = [k for k in TABLES[name].unique if set(k) <= set(df.columns)]
        found = []
        for k in keys:
            whole = F.lit(True)
            for c in k:
                whole = whole & F.col(c).isNotNull()
            found.append(F.when(whole, F.struct(F.lit(len(rules)).alias("rule_no"),
                                                F.to_json(F.array(*[F.col(c).cast("string") for c in k])).alias("key"))))
            rules.append((len(rules), name, f"unique ({', '.join(k)})"))
        if found:
            parts.append(df.select(F.explode(F.array_compact(F.array(*found))).alias("k")).select("k.*"))
    counts = _union_all(parts).groupBy("rule_no", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("rule_no").agg(
        F.sum("n").alias("checked"), F.sum(F.col("n") - 1).alias("violations"))
    return _named(_spark(tables), rules, counts)


def _named(spark, rules: list[tuple[int, str, str]], counts: DataFrame) -> DataFrame:
    """A row for every rule, with zeros where nothing was checked. ``rules`` are the schema's own, a few dozen."""
    names = F.broadcast(spark.createDataFrame(rules, "rule_no int, table_name string, rule string"))
    zero = F.lit(0).cast("long")
    return counts.join(names, "rule_no", "right").select(
        "table_name", "rule", F.coalesce("checked", zero).alias("checked"), F.coalesce("violations", zero).alias("violations"))


def _references(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """(child, column, parent, parent's column) of every declared reference that the tables have both ends of."""
    return [(name, c, parent, key) for name, df in tables.items() for c, (parent, key, _) in TABLES[name].references.items()
            if c in df.columns and parent in tables and key in tables[parent].columns]


#: References to one parent that are counted side by side in a row of the grouping.
LANE = 3


def reference_keys(tables: dict[str, DataFrame]) -> tuple[DataFrame, list[tuple[int, str, str]]]:
    """V-05 in one pass: every referenced key with the rows of each reference that
    hold it, and whether the parent has it. Columns rule_no, key, n, found.

    Each table is scanned once. A row becomes a tagged key for each of its
    references, a parent's row one for its own key; grouped by (parent, key), a
    count per tag and a flag decide LANE references to that parent at once. The
    grouping is the only shuffle and is aggregated before it, so a key that a third
    of the rows hold is one row per task. A NULL key references nothing."""
    refs = _references(tables)
    rules = [(i, child, f"{c} -> {parent}.{key}") for i, (child, c, parent, key) in enumerate(refs)]
    # A parent with many references is several groups of LANE, which keeps the rows of the grouping narrow.
    lanes = []
    for p in sorted({(parent, key) for _, _, parent, key in refs}):
        own = [i for i, r in enumerate(refs) if r[2:] == p]
        lanes += [(*p, own[at:at + LANE]) for at in range(0, len(own), LANE)]
    slots = max(len(own) for _, _, own in lanes)
    parts = []
    for name, df in tables.items():
        held = [(n, s, refs[i][1]) for n, (_, _, own) in enumerate(lanes) for s, i in enumerate(own) if refs[i][0] == name]
        held += [(n, -1, key) for n, (parent, key, _) in enumerate(lanes) if parent == name]
        if held:
            x = F.array(*[F.struct(F.lit(p).alias("parent"), F.lit(s).alias("slot"), F.col(c).cast("string").alias("key"))
                          for p, s, c in held])
            parts.append(df.select(F.explode(x).alias("x")).select("x.*").filter(F.col("key").isNotNull()))
    keys = _union_all(parts).groupBy("parent", "key").agg(
        F.max(F.col("slot") == -1).alias("found"), *[F.count_if(F.col("slot") == s).alias(f"n{s}") for s in range(slots)])
    numbers = F.lit(None).cast("array<int>")  # of a group: its rules by slot
    for n, (_, _, own) in enumerate(lanes):
        numbers = F.when(F.col("parent") == n, F.array(*[F.lit(i) for i in own])).otherwise(numbers)
    per_slot = F.transform(numbers, lambda rule, s: F.struct(
        rule.alias("rule_no"), F.get(F.array(*[F.col(f"n{i}") for i in range(slots)]), s).alias("n")))
    rows = keys.select("key", "found", F.explode(F.filter(per_slot, lambda r: r["n"] > 0)).alias("r"))
    return rows.select("r.rule_no", "key", "r.n", "found"), rules


def reference_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """V-05 as one row per reference: rows with a key, and those whose key no parent has."""
    keys, rules = reference_keys(tables)
    counts = keys.groupBy("rule_no").agg(F.sum("n").alias("checked"),
                                         F.sum(F.when(~F.col("found"), F.col("n")).otherwise(0)).alias("violations"))
    return _named(_spark(tables), rules, counts)


def orphan_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """V-05: every key that no parent has, with its reference and the rows that hold it."""
    keys, rules = reference_keys(tables)
    names = F.broadcast(_spark(tables).createDataFrame(rules, "rule_no int, table_name string, rule string"))
    return keys.filter(~F.col("found")).join(names, "rule_no").select(
        "table_name", "rule", F.col("key").alias("row_key"), F.col("n").alias("rows"))


# --------------------------------------------------------------------- V-06
def cascade_delete(tables: dict[str, DataFrame], gone: dict[str, DataFrame],
                   links: dict[str, list[tuple[str, list[str], list[str]]]]) -> dict[str, DataFrame]:
    """ON DELETE CASCADE, transitively. ``gone`` holds the keys of rows deleted
    outright, by table; ``links`` lists for each table, parents first, its
    cascading references (parent, own columns, parent's columns). Every table
    comes back with ``is_gone``: listed itself, or a parent's row is gone. A
    reference with a NULL part does not cascade. Each table is read once and
    joined with the keys that went, never with whole parents."""
    out: dict[str, DataFrame] = {}
    for name, refs in links.items():
        df, flag = tables[name], F.lit(False)
        keys = [(gone[name], list(gone[name].columns), list(gone[name].columns))] if name in gone else []
        keys += [(out[parent].filter("is_gone"), own, theirs) for parent, own, theirs in refs]
        for i, (parent, own, theirs) in enumerate(keys):
            g = parent.select(*[F.col(b).alias(f"_k{i}_{n}") for n, b in enumerate(theirs)]).distinct()
            g = g.dropna().withColumn(f"_g{i}", F.lit(True))
            cond = F.lit(True)
            for n, a in enumerate(own):
                cond = cond & (F.col(a) == F.col(f"_k{i}_{n}"))
            df = df.join(g, cond, "left")
            flag = flag | F.coalesce(F.col(f"_g{i}"), F.lit(False))
        out[name] = df.select(*tables[name].columns, flag.alias("is_gone"))
    return out


def cascade_summary(flagged: dict[str, DataFrame]) -> DataFrame:
    """(table, kept, removed) counts; one pass over each table."""
    out = None
    for name, df in flagged.items():
        one = df.agg(F.count(F.when(~F.col("is_gone"), 1)).alias("kept"),
                     F.count(F.when(F.col("is_gone"), 1)).alias("removed")).withColumn("table_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("table_name", "kept", "removed")


# --------------------------------------------------------------------- V-07
def check_total_value(tx: DataFrame) -> DataFrame:
    expect = (F.col("quantity") * F.col("price")).cast("decimal(15,2)")
    return tx.filter(expect != F.col("total_value")).withColumn("expected_total_value", expect)
