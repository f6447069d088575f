"""Operator 7: mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, stored
from .registry import query

OTHER = "(other)"
SWEEPS = 12


def token_count(text: Column) -> Column:
    """Number of runs without blank, tab or line end; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def form_topic(text: Column) -> Column:
    """The topic where no topic column is given: the form of the text."""
    size = F.length(text)

    def share(mark: str) -> Column:
        return size - F.length(F.replace(text, F.lit(mark), F.lit("")))

    tokens = token_count(text)
    return (
        F.when(text.isNull() | (tokens == 0), "empty")
        .when(share(" | ") * 10 > size, "table")
        .when(share("!!") * 20 > size, "shout")
        .when(tokens < 50, "short")
        .when(tokens >= 1000, "long")
        .otherwise("prose")
    )


def rake(cells: dict[tuple, float], targets: list[dict[str, float]], sweeps: int = SWEEPS) -> dict[tuple, float]:
    """Weights of the cells whose sums along every dimension agree with the targets.

    A dimension's targets are shares of its listed values; what is not listed is one value, (other), that keeps its share. Listed
    values without tokens are left out and the others share what is theirs. ``sweeps`` passes over the dimensions are made.
    """
    weights = {k: v for k, v in cells.items() if v > 0}
    total = sum(weights.values())
    goals = []
    for d, wanted in enumerate(targets):
        have: dict = defaultdict(float)
        for k, v in weights.items():
            have[k[d]] += v
        listed = {k: wanted[k] for k in have if wanted.get(k, 0) > 0 and k != OTHER}
        free = total - sum(v for k, v in have.items() if k != OTHER and k not in listed and k in wanted)
        rest = have.get(OTHER, 0.0) if listed else 0.0
        scale = sum(listed.values())
        goal = {k: v / scale * (total - rest) for k, v in listed.items()}
        goal.update({k: 0.0 for k in have if k in wanted and k not in listed and k != OTHER} if free > 0 else {})
        if OTHER in have:
            goal[OTHER] = rest if listed else have[OTHER]
        goals.append(goal if listed else dict(have))
    for _ in range(sweeps):
        for d, goal in enumerate(goals):
            have = defaultdict(float)
            for k, v in weights.items():
                have[k[d]] += v
            weights = {k: v * goal[k[d]] / have[k[d]] if have[k[d]] else 0.0 for k, v in weights.items()}
    return weights


def clipped(weights: dict[tuple, float], tokens: dict[tuple, float], kept: float) -> dict[tuple, float]:
    """Probabilities in proportion to the weights, none above 1, that keep the share ``kept`` of the tokens, or all that can be kept."""
    free, sure = {k for k, w in weights.items() if w > 0}, set()
    goal = kept * sum(tokens[k] for k in weights)
    scale = 0.0
    while free:
        scale = max(goal - sum(tokens[k] for k in sure), 0.0) / sum(tokens[k] * weights[k] for k in free)
        over = {k for k in free if scale * weights[k] >= 1}
        if not over:
            break
        sure, free = sure | over, free - over
    return {k: 1.0 if k in sure else scale * w for k, w in weights.items()}


def held_back(documents: DataFrame, times: float = 3.0, least: float = 0.1, listed: int = 200) -> tuple[list[dict[str, float]], float]:
    """Targets for ``mix`` (sources, languages, none for topics) from the table's own shares of tokens, and the share of tokens they keep.

    A value is over-represented with more than ``times`` the even share of its column, and more than ``least`` of all tokens; it
    is held back to that, and all else stays as it is. A column's ``listed`` largest values get targets.
    """
    cells = stored(
        documents.select("source", "lang", token_count(F.col("text")).alias("n")).groupBy("source", "lang").agg(F.sum("n").alias("n")).where("n > 0"),
        "cells",
    )
    total = cells.agg(F.sum("n")).first()[0] or 0
    targets, kept = [], 1.0
    for column in ("source", "lang"):
        sums = cells.where(F.col(column).isNotNull() & (F.col(column) != OTHER)).groupBy(column).agg(F.sum("n").alias("n"))
        values = sums.count()
        most = max(least, times / max(values, 1)) * total
        have = {r[column]: float(r["n"]) for r in sums.orderBy(F.desc("n"), column).limit(listed).collect()}
        wanted = {k: min(n, most) for k, n in have.items()}
        kept = min(kept, 1 - (sum(have.values()) - sum(wanted.values())) / total) if total else kept
        targets.append({k: n / total for k, n in wanted.items()})
    return [*targets, {}], kept


def mix(
    documents: DataFrame,
    sources: dict[str, float],
    langs: dict[str, float],
    topics: dict[str, float],
    topic: Column | None = None,
    rate: float = 1.0,
    seed: int = 7,
    sweeps: int = SWEEPS,
    kept: float | None = None,
) -> DataFrame:
    """Rake token weights to the three marginals, then sample documents by calibrated probabilities.

    Returns (row, n_tokens, source_cell, lang_cell, topic_cell, weight, probability, sampled), where ``row`` is the whole input
    row, so names of further columns cannot clash. ``weight`` is the raked tokens of the row's cell over its tokens;
    ``probability`` is rate * weight / largest weight; a row is sampled if a hash of (seed, doc_id) falls below it, so repeated
    rows share their draw. Expected tokens of the sample have the wanted shares. With ``kept`` given, probabilities are clipped at
    1 and the rest scaled so that this share of the tokens is expected (``clipped``; ``rate`` has no part in it): one short
    cell then does not set the rate of all, at the price of its own share.

    A null source or lang and every value without a target counts as (other), which keeps its share. A null, empty or blank text
    has no tokens: weight and probability 0, never sampled. A null doc_id is drawn like an empty one. An empty table gives none.

    One aggregate counts tokens by cell. The cell table has at most (sources + 1)(langs + 1)(topics + 1) rows, bounded by the
    arguments and not by the data, so it is raked on the driver and broadcast. No text is shuffled.
    """
    spark = documents.sparkSession
    text = F.col("row.text")

    def cell(value: Column, wanted: dict[str, float]) -> Column:
        return F.when(value.isin(list(wanted)), value).otherwise(OTHER)

    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    rows = rows.select(
        "row",
        token_count(text).alias("n_tokens"),
        cell(F.col("row.source"), sources).alias("source_cell"),
        cell(F.col("row.lang"), langs).alias("lang_cell"),
        cell(topic if topic is not None else form_topic(text), topics).alias("topic_cell"),
    )
    keys = ["source_cell", "lang_cell", "topic_cell"]
    cells = {tuple(r[k] for k in keys): float(r["n"]) for r in rows.groupBy(keys).agg(F.sum("n_tokens").alias("n")).collect()}
    weights = {k: v / cells[k] for k, v in rake(cells, [sources, langs, topics], sweeps).items()}
    top = max(weights.values(), default=1.0)
    drawn = {k: rate * v / top for k, v in weights.items()} if kept is None else clipped(weights, cells, kept)
    table = spark.createDataFrame(
        [(*k, v, drawn[k]) for k, v in weights.items()],
        "source_cell string, lang_cell string, topic_cell string, weight double, probability double",
    )
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row.doc_id").cast("string"))), 1, 8), 16, 10)
    own = F.when(F.col("n_tokens") > 0, F.col("weight"))
    return (
        rows.join(F.broadcast(table), keys, "left")
        .withColumn("weight", F.coalesce(own, F.lit(0.0)))
        .withColumn("probability", F.when(F.col("weight") > 0, F.col("probability")).otherwise(0.0))
        .withColumn("sampled", draw.cast("double") / 4294967296.0 < F.col("probability"))
    )


#: Wanted shares of tokens: the sources alike, English somewhat less than it has, long texts somewhat held back.
SOURCES = {f"src{i}": 0.05 for i in range(20)}
LANGS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
TOPICS = {"prose": 0.65, "long": 0.35}


def _oracle() -> str:
    def values(name: str, wanted: dict[str, float]) -> str:
        return f"{name}(k, goal) AS (VALUES {', '.join(f'({k!r}, {v!r}::DOUBLE)' for k, v in wanted.items())})"

    dims = [("s", "src_t", SOURCES), ("l", "lang_t", LANGS), ("t", "topic_t", TOPICS)]
    out = ["WITH " + ",\n".join(values(n, w) for _, n, w in dims)]
    n = r"len(regexp_extract_all(text, '[^ \t\n\r]+'))"
    out.append(f"base AS (SELECT doc_id, source, lang, text, coalesce({n}, 0)::BIGINT AS n_tokens, length(text) AS size FROM documents)")
    out.append("""formed AS (SELECT doc_id, n_tokens, source, lang, CASE WHEN text IS NULL OR n_tokens = 0 THEN 'empty'
      WHEN (size - length(replace(text, ' | ', ''))) * 10 > size THEN 'table'
      WHEN (size - length(replace(text, '!!', ''))) * 20 > size THEN 'shout'
      WHEN n_tokens < 50 THEN 'short' WHEN n_tokens >= 1000 THEN 'long' ELSE 'prose' END AS topic FROM base)""")
    out.append("""celled AS (SELECT doc_id, n_tokens, coalesce(a.k, '(other)') AS s, coalesce(b.k, '(other)') AS l, coalesce(c.k, '(other)') AS t
      FROM formed LEFT JOIN src_t a ON a.k = source LEFT JOIN lang_t b ON b.k = lang LEFT JOIN topic_t c ON c.k = topic)""")
    out.append("cells AS (SELECT s, l, t, sum(n_tokens)::DOUBLE AS n FROM celled GROUP BY ALL HAVING sum(n_tokens) > 0)")
    for d, name, _ in dims:
        out.append(f"have_{d} AS (SELECT {d} AS k, sum(n) AS n FROM cells GROUP BY 1)")
        out.append(f"""goal_{d} AS (SELECT h.k, CASE WHEN h.k = '(other)' THEN h.n ELSE g.goal / (SELECT sum(x.goal) FROM {name} x JOIN have_{d} y ON y.k = x.k)
          * ((SELECT sum(n) FROM have_{d}) - coalesce((SELECT n FROM have_{d} WHERE k = '(other)'), 0)) END AS want FROM have_{d} h LEFT JOIN {name} g ON g.k = h.k)""")
    before = "SELECT s, l, t, n, n AS w FROM cells"
    out.append(f"w0 AS MATERIALIZED ({before})")
    i = 0
    for _ in range(SWEEPS):
        for d, _, _ in dims:
            out.append(f"w{i + 1} AS MATERIALIZED (SELECT s, l, t, n, w * g.want / sum(w) OVER (PARTITION BY {d}) AS w FROM w{i} JOIN goal_{d} g ON g.k = {d})")
            i += 1
    tail = f"""SELECT doc_id, n_tokens, c.s AS source_cell, c.l AS lang_cell, c.t AS topic_cell,
      round(CASE WHEN n_tokens > 0 THEN w / n ELSE 0 END, 6) AS weight,
      round(CASE WHEN n_tokens > 0 THEN w / n / (SELECT max(w / n) FROM w{i}) ELSE 0 END, 6) AS probability,
      ('0x' || substr(md5('7:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < CASE WHEN n_tokens > 0 THEN w / n / (SELECT max(w / n) FROM w{i}) ELSE 0 END AS sampled
      FROM celled c LEFT JOIN w{i} x ON x.s = c.s AND x.l = c.l AND x.t = c.t"""
    return ",\n".join(out) + "\n" + tail


@query("op7_mixing", _oracle())
def op7_mixing(spark, sf_dir):
    mixed = mix(read(spark, sf_dir, "documents"), SOURCES, LANGS, TOPICS)
    return mixed.select(
        "row.doc_id", "n_tokens", "source_cell", "lang_cell", "topic_cell", F.round("weight", 6).alias("weight"),
        F.round("probability", 6).alias("probability"), "sampled",
    )
