"""Problem 7: a sample that matches target category proportions.

Per field, the needed counts are spread over a second stratum in proportion to
what is there; the fractional two-way table is made integer by max-flow, both
margins kept (controlled rounding), and each cell then takes exactly its quota
of rows by smallest random key.  A cell may hold a third of all rows: its cut
key is found from a key histogram of about as many buckets as the root of its rows,
and only the one bucket at the cut is ranked.  A target isn't met if the sample
took all rows of its category and they are fewer than needed.

Defined cases: a value counts after trim and lower case; null values match no
category; a category that no row has gets 0 rows and is reported; a null share
or minimum counts as 0; ties of the random key go by id; an empty table needs
only the minima; a category listed twice for one field has its shares summed.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest two-way table rounded on the driver, in cells (categories x strata), and most targets; more raise an error.
MAX_CELLS = 20_000


def normal(col: Column) -> Column:
    return F.lower(F.trim(col))


def needs(rows: DataFrame, targets: DataFrame, fields: dict[str, Column], fraction: float = 0.1) -> DataFrame:
    """(field_name, category, available, needed): the targets against what is there.

    needed = max(min_rows, target_share x floor(fraction x all rows)).
    """
    tenth = rows.agg(F.floor(F.count(F.lit(1)) * F.lit(fraction) + F.lit(1e-9))).scalar()
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("field_name"), normal(c).alias("category")) for k, c in fields.items()])).alias("p")
    have = rows.select(pairs).select("p.*").groupBy("field_name", "category").agg(F.count(F.lit(1)).alias("available"))
    want = targets.groupBy("field_name", "category").agg(F.sum("target_share").alias("share"), F.max("min_rows").alias("least")).fillna(0, ["share", "least"])
    t = want.join(have, ["field_name", "category"], "left").fillna(0, ["available"]).withColumn("tenth", tenth)
    needed = F.greatest(F.col("least").cast("double"), F.col("share") * F.col("tenth"))
    return t.select("field_name", "category", "available", needed.alias("needed"))


def round_table(table: list[list[float]]) -> list[list[int]]:
    """Controlled rounding: floor or ceiling of every cell, row sum and column sum of ``table``.

    The fractional parts are a feasible flow rows -> columns with unit cells; an
    integral one with the same bounds exists, and augmenting paths find it.
    """
    n, m = len(table), len(table[0]) if table else 0
    eps = 1e-9
    base = [[math.floor(x + eps) for x in row] for row in table]
    frac = [[max(0.0, table[i][j] - base[i][j]) for j in range(m)] for i in range(n)]
    row_sum = [sum(table[i]) for i in range(n)]
    col_sum = [sum(table[i][j] for i in range(n)) for j in range(m)]
    low_r = [math.floor(row_sum[i] + eps) - sum(base[i]) for i in range(n)]
    high_r = [math.ceil(row_sum[i] - eps) - sum(base[i]) for i in range(n)]
    low_c = [math.floor(col_sum[j] + eps) - sum(base[i][j] for i in range(n)) for j in range(m)]
    high_c = [math.ceil(col_sum[j] - eps) - sum(base[i][j] for i in range(n)) for j in range(m)]
    total = round(sum(row_sum)) - sum(map(sum, base))
    # Lower bounds as supply and demand: S -> row, column -> T, and T' -> S' back edges.
    size = n + m + 4
    s, t, ss, tt = n + m, n + m + 1, n + m + 2, n + m + 3
    cap: list[dict[int, int]] = [{} for _ in range(size)]

    def edge(u: int, v: int, low: int, high: int) -> None:
        if high > low:
            cap[u][v] = cap[u].get(v, 0) + high - low
            cap[v].setdefault(u, 0)
        if low > 0:
            for x, y in ((ss, v), (u, tt)):
                cap[x][y] = cap[x].get(y, 0) + low
                cap[y].setdefault(x, 0)

    for i in range(n):
        edge(s, i, low_r[i], high_r[i])
        for j in range(m):
            if frac[i][j] > eps:
                edge(i, n + j, 0, 1)
    for j in range(m):
        edge(n + j, t, low_c[j], high_c[j])
    edge(t, s, total, total)
    while True:
        seen = {ss: -1}
        queue = deque([ss])
        while queue and tt not in seen:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 0 and v not in seen:
                    seen[v] = u
                    queue.append(v)
        if tt not in seen:
            break
        v, least = tt, 1 << 60
        while v != ss:
            least = min(least, cap[seen[v]][v])
            v = seen[v]
        v = tt
        while v != ss:
            cap[seen[v]][v] -= least
            cap[v][seen[v]] += least
            v = seen[v]
    return [[base[i][j] + (cap[n + j].get(i, 0) if frac[i][j] > eps else 0) for j in range(m)] for i in range(n)]


def quotas(rows: DataFrame, targets: DataFrame, field: str, value: Column, stratum: Column, need: DataFrame) -> DataFrame:
    """(category, stratum, quota, bits): integer quotas of one field and the bits of a key that number its histogram, as a small table.

    Counts per (category, stratum) come to the driver, at most MAX_CELLS of them:
    the table is that of the targets' categories, not of all values.
    """
    spark = rows.sparkSession
    listed = targets.where(F.col("field_name") == field).select("category").distinct()
    cells = rows.select(normal(value).alias("category"), F.coalesce(stratum, F.lit("\x00")).alias("stratum")).join(F.broadcast(listed), "category").groupBy("category", "stratum").count()
    got = cells.limit(MAX_CELLS + 1).collect()
    if len(got) > MAX_CELLS:
        raise ValueError(f"{field}: the two-way table has more than {MAX_CELLS} cells; choose a coarser stratum")
    listed_needs = need.where(F.col("field_name") == field).limit(MAX_CELLS + 1).collect()
    if len(listed_needs) > MAX_CELLS:
        raise ValueError(f"{field}: more than {MAX_CELLS} targets")
    want = {r["category"]: (r["needed"], r["available"]) for r in listed_needs}
    names = sorted({r["category"] for r in got})
    strata = sorted({r["stratum"] for r in got})
    count = {(r["category"], r["stratum"]): r["count"] for r in got}
    table = [[min(want[c][0], want[c][1]) * count.get((c, x), 0) / want[c][1] for x in strata] for c in names]
    done = round_table(table) if names else []
    out = [(c, x, min(done[i][j], count.get((c, x), 0)), math.ceil(math.log2(count.get((c, x), 0) + 1) / 2)) for i, c in enumerate(names) for j, x in enumerate(strata) if done[i][j] > 0]
    return spark.createDataFrame(out, "category string, stratum string, quota long, bits int")


def draw(rows: DataFrame, quota: DataFrame, value: Column, stratum: Column, id_col: str, seed: int = 42) -> DataFrame:
    """(id, category): exactly ``quota`` rows of each cell, those of smallest random key."""
    key = F.xxhash64(F.col(id_col), F.lit(seed))
    keyed = rows.select(F.col(id_col).alias("id"), normal(value).alias("category"), F.coalesce(stratum, F.lit("\x00")).alias("stratum"), key.alias("key"))
    keyed = keyed.join(F.broadcast(quota), ["category", "stratum"])  # quota: MAX_CELLS rows at most
    bucket = F.when(F.col("bits") == 0, F.lit(0)).otherwise(F.expr("int(shiftrightunsigned(key, 64 - bits))"))
    keyed = keyed.withColumn("bucket", bucket).drop("bits")
    from pyspark.sql import Window

    hist = keyed.groupBy("category", "stratum", "quota", "bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("category", "stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = hist.withColumn("upto", upto).where("upto >= quota and upto - n < quota").select("category", "stratum", F.col("bucket").alias("cut"), (F.col("quota") - (F.col("upto") - F.col("n"))).alias("left"))
    marked = keyed.join(F.broadcast(cut), ["category", "stratum"])  # one row per cell
    whole = marked.where("bucket < cut").select("id", "category")
    place = F.row_number().over(Window.partitionBy("category", "stratum").orderBy("key", "id"))
    edge = marked.where("bucket = cut").withColumn("place", place).where("place <= left").select("id", "category")
    return whole.unionByName(edge)


def sample(rows: DataFrame, targets: DataFrame, fields: dict[str, Column], stratum: Column, id_col: str, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """(field_name, category, id): one draw per field."""
    need = needs(rows, targets, fields, fraction)
    out = None
    for field, value in fields.items():
        q = quotas(rows, targets, field, value, stratum, need)
        part = draw(rows, q, value, stratum, id_col, seed).select(F.lit(field).alias("field_name"), "category", "id")
        out = part if out is None else out.unionByName(part)
    return out


def report(rows: DataFrame, targets: DataFrame, fields: dict[str, Column], drawn: DataFrame, fraction: float = 0.1) -> DataFrame:
    """Targets with what was drawn: (field_name, category, available, needed, drawn, share, short)."""
    from pyspark.sql import Window

    got = drawn.groupBy("field_name", "category").agg(F.count(F.lit(1)).alias("drawn"))
    t = needs(rows, targets, fields, fraction).join(got, ["field_name", "category"], "left").fillna(0, ["drawn"])
    short = (F.col("drawn") == F.col("available")) & (F.col("drawn") < F.col("needed"))  # the sample took all there is
    return t.withColumn("share", F.try_divide(F.col("drawn"), F.sum("drawn").over(Window.partitionBy("field_name")))).withColumn("short", short)
