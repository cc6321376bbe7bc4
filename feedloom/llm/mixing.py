"""Mixing sources to target weights over a tree of domain, language and source.

Budget. The token budget enters at the root and is split among the children of a node by their weights. A
node can take no more than its capacity: a leaf's is its tokens times the epochs it may be repeated, a node's
the sum of its children's. What one child cannot take goes to its siblings by weight, and only what all
children together cannot take stays with the parent's siblings: shortages are met by siblings before ancestors.
For the children of a node this is a water level. Sorted by capacity over weight, child i is full if
``capacity_i * W <= (budget - C) * weight_i``, where C is the capacity before it and W the weight from it on;
the others share the rest by weight, rounded down. All of it is whole-number arithmetic.

Selection. Epoch e of a leaf is its documents in the order of a hash of (seed, e, doc_id). A leaf with
budget b and T tokens takes b div T whole epochs and, of the next one, the prefix of documents whose first
token lies below b mod T. So a document comes once for each epoch that holds it; the last one overshoots by less
than its own length.

Scale. Documents are never sorted or shuffled with their text. Their tokens are summed per leaf and slice of the
hash range, ahead of the shuffle; running sums over the slices of a leaf show the one slice where the prefix
ends, and only that slice (one in 4096 of a leaf) is ordered document by document, in a group of its own.
What remains is one row per leaf, with the last hash taken, and a filter per document. Leaves are counted;
they are broadcast up to ``runtime.BROADCAST_ROWS`` and joined by a shuffle that splits hot keys beyond.

Defined cases: a null language or source is the leaf ``none``; a document without words (or null) has no tokens, adds
nothing to a budget and is taken with an epoch if its place lies in it; a leaf without tokens gets no budget and
gives no rows; rows with the same doc_id (or none) have one place in an epoch and are taken together; a weight that is
not listed is 1, a weight of 0 excludes; an empty table gives an empty one. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom import runtime
from feedloom.llm.common import landed, table

# Hex digits of a place that name its slice: a leaf has 16 ** 3 = 4096 slices.
SLICE_DIGITS = 3
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Targets of a mixture.

    ``domains`` names the domain of a source; other sources are in ``other_domain``. Weights are whole numbers
    and compare siblings only. The budget is ``budget_num / budget_den`` of the corpus' tokens.
    """

    domains: Mapping[str, str] = field(default_factory=dict)
    other_domain: str = "web"
    domain_weights: Mapping[str, int] = field(default_factory=dict)
    lang_weights: Mapping[str, int] = field(default_factory=dict)
    source_weights: Mapping[str, int] = field(default_factory=dict)
    budget_num: int = 1
    budget_den: int = 1
    max_epochs: int = 4
    seed: int = 17

    def weights(self, level: str) -> Mapping[str, int]:
        return {"domain": self.domain_weights, "lang": self.lang_weights, "source": self.source_weights}[level]


PRODUCTION = Mix(
    domains={
        **{f"src{i}": "news" for i in range(1, 7)},
        **{f"src{i}": "reference" for i in range(7, 13)},
        **{f"src{i}": "forum" for i in range(13, 20)},
    },
    domain_weights={"web": 30, "news": 25, "reference": 30, "forum": 15},
    lang_weights={"en": 50, "de": 20, "fr": 20, "es": 10},
    budget_num=9,
    budget_den=10,
    max_epochs=2,
)


def token_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _mapped(values: Mapping[str, object], key: Column, other: object) -> Column:
    if not values:
        return F.lit(other)
    pairs = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(pairs[key], F.lit(other))


def _leaf(docs: DataFrame, mix: Mix) -> list[Column]:
    source = F.coalesce(docs["source"].cast("string"), F.lit("none"))
    lang = F.coalesce(docs["lang"].cast("string"), F.lit("none"))
    return [
        _mapped(mix.domains, source, mix.other_domain).alias("domain"),
        lang.alias("lang"),
        source.alias("source"),
        docs["doc_id"],
    ]


def _place(mix: Mix) -> Column:
    """Place of a document in the epoch that its leaf takes in part; equal for equal ids."""
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("epochs").cast("string"), named))


def _share(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Split each parent's ``budget`` among its children by ``weight``, up to their ``capacity``."""
    exact = "decimal(38,0)"
    nodes = nodes.where("weight > 0")
    # capacity / weight without rounding: its whole part, then 18 decimals, which tell apart any two quotients of weights below 1e9.
    whole_part = F.expr("capacity div weight")
    decimals = F.expr(f"(CAST(capacity % weight AS {exact}) * CAST(1000000000000000000 AS {exact})) div weight")
    by = Window.partitionBy(*parent).orderBy(whole_part, decimals, child)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    exact_sum = lambda column, window: F.coalesce(F.sum(column).over(window), F.lit(0)).cast(exact)
    levels = nodes.withColumns({"c": exact_sum("capacity", before), "w": exact_sum("weight", after)})
    fits = F.expr(f"CAST(capacity AS {exact}) * w <= greatest(budget - c, CAST(0 AS {exact})) * weight")
    levels = levels.withColumn("full", fits)
    whole = Window.partitionBy(*parent)
    levels = levels.withColumns(
        {
            "taken": exact_sum(F.when(F.col("full"), F.col("capacity")), whole),
            "open": exact_sum(F.when(~F.col("full"), F.col("weight")), whole),
        }
    )
    part = F.least(F.expr("((budget - taken) * weight) div open"), F.col("capacity"))
    return levels.select(*parent, child, F.when(F.col("full"), F.col("capacity")).otherwise(part).alias("budget"))


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, tokens, budget) from (domain, lang, source, tokens), one row per leaf."""
    leaves = leaves.withColumns({"root": F.lit(0), "capacity": F.col("tokens") * mix.max_epochs})
    budget = F.expr(f"coalesce(sum(tokens), 0) * {mix.budget_num} div {mix.budget_den}")
    shares, parent = leaves.groupBy("root").agg(budget.alias("budget")), ["root"]
    for level in LEVELS:
        nodes = leaves.groupBy(*parent, level).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", _mapped(mix.weights(level), F.col(level), 1).cast("long"))
        shares = _share(nodes.join(shares, parent), parent, level)
        parent = [*parent, level]
    return leaves.join(shares, parent).select(*LEVELS, "tokens", "budget")


def plan(docs: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """Documents without their text, and per leaf: tokens, budget, epochs, last hash taken of the next epoch."""
    placed = landed(docs.select(*_leaf(docs, mix), token_count(docs["text"]).alias("n")), "placed")
    leaves = landed(placed.groupBy(*LEVELS).agg(F.sum("n").alias("tokens")), "leaves")
    shared = landed(budgets(leaves, mix), "budgets").where("budget > 0 AND tokens > 0")
    shared = shared.selectExpr(
        *LEVELS, "tokens", "budget", "budget div tokens AS epochs", "budget % tokens AS rest"
    )
    side = F.broadcast(shared) if runtime.fits_broadcast(shared) else shared
    rows = placed.join(side, list(LEVELS)).withColumn("place", _place(mix))
    # The first digits of a place are its slice.
    rows = rows.withColumn("slice", F.substring("place", 1, SLICE_DIGITS))
    sums = rows.groupBy(*LEVELS, "slice").agg(F.sum("n").alias("n"), F.max("rest").alias("rest"))
    by = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(by), F.lit(0)))
    # The last slice that begins below the rest is where the prefix ends.
    ends = sums.where("rest > 0 AND before < rest").groupBy(*LEVELS).agg(F.max_by(F.struct("slice", "before"), "slice").alias("e"))
    ends = landed(ends.select(*LEVELS, F.col("e.slice").alias("slice"), "e.before"), "prefix-ends")
    inside = rows.join(F.broadcast(ends) if runtime.fits_broadcast(ends) else ends, [*LEVELS, "slice"])
    inside = inside.groupBy(*LEVELS, "slice", "before", "rest", "place").agg(F.sum("n").alias("n"))
    within = Window.partitionBy(*LEVELS, "slice").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))
    last = inside.withColumn("start", start).where("start < rest").groupBy(*LEVELS).agg(F.max("place").alias("last"))
    chosen = shared.join(last, list(LEVELS), "left")
    return placed, landed(chosen, "chosen")


def _copies(mix: Mix) -> Column:
    """How often a document is taken, from its leaf's ``epochs`` and ``last``."""
    more = F.col("last").isNotNull() & (_place(mix) <= F.col("last"))
    return (F.col("epochs") + more.cast("long")).alias("copies")


def _chosen(rows: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    side = chosen.select(*LEVELS, "epochs", "last")
    return rows.join(F.broadcast(side) if runtime.fits_broadcast(side) else side, list(LEVELS), how)


def counted(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, copies) of every document, copies 0 where it is left out."""
    placed, chosen = plan(docs, mix)
    copies = F.coalesce(_copies(mix), F.lit(0)).cast("long").alias("copies")
    return _chosen(placed, chosen, "left").select("doc_id", *LEVELS, F.col("n").alias("tokens"), copies)


def mix_documents(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """The mixture: every taken document, once per epoch that holds it, with all its columns."""
    _, chosen = plan(docs, mix)
    packed = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("packed")
    rows = _chosen(docs.select(*_leaf(docs, mix), packed), chosen, "inner")
    taken = rows.select("packed", _copies(mix)).where("copies > 0")
    taken = taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return taken.select(*[F.col(f"packed.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _case(values: Mapping[str, object], column: str, other: object) -> str:
    shown = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    whens = "".join(f" WHEN '{key}' THEN {shown(value)}" for key, value in values.items())
    return f"CASE {column}{whens} ELSE {shown(other)} END" if values else shown(other)


def _share_sql(name: str, parent: str, children: str, level: str, weights: Mapping[str, int]) -> str:
    """One level of the budget as SQL: ``name`` from the table ``parent`` of shares."""
    keys, own = ", ".join(children.split()), ", ".join([*children.split(), level])
    return f"""
{name}_n AS (SELECT {own}, sum(capacity) AS capacity, {_case(weights, level, 1)} AS weight FROM leaves GROUP BY {own}),
{name}_l AS (SELECT n.*, budget, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w,
   coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
   FROM {name}_n n JOIN {parent} USING ({keys}) WHERE weight > 0
   WINDOW w AS (PARTITION BY {keys} ORDER BY capacity // weight,
      CAST(capacity % weight AS HUGEINT) * 1000000000000000000 // weight, {level})),
{name}_f AS (SELECT *, capacity * w <= greatest(budget - c, 0) * weight AS is_full FROM {name}_l),
{name}_t AS (SELECT *, coalesce(sum(CASE WHEN is_full THEN capacity END) OVER p, 0) AS taken,
   coalesce(sum(CASE WHEN NOT is_full THEN weight END) OVER p, 0) AS free FROM {name}_f WINDOW p AS (PARTITION BY {keys})),
{name} AS (SELECT {own}, CASE WHEN is_full THEN capacity
   ELSE least(((budget - taken) * weight) // greatest(free, 1), capacity) END AS budget FROM {name}_t),"""


def mix_sql(mix: Mix) -> str:
    """``counted`` as SQL."""
    return f"""
WITH d AS (SELECT doc_id, {_case(mix.domains, "source", mix.other_domain)} AS domain, lang, source, tokens
   FROM (SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
      CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents)),
leaves AS (SELECT 0 AS root, domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS tokens,
   CAST(sum(tokens) AS HUGEINT) * {mix.max_epochs} AS capacity FROM d GROUP BY domain, lang, source),
top AS (SELECT 0 AS root, coalesce(sum(tokens), 0) * {mix.budget_num} // {mix.budget_den} AS budget FROM leaves),
{_share_sql("s1", "top", "root", "domain", mix.domain_weights)}
{_share_sql("s2", "s1", "root domain", "lang", mix.lang_weights)}
{_share_sql("s3", "s2", "root domain lang", "source", mix.source_weights)}
chosen AS (SELECT domain, lang, source, budget // tokens AS epochs, budget % tokens AS rest
   FROM leaves JOIN s3 USING (domain, lang, source) WHERE budget > 0 AND tokens > 0),
places AS (SELECT d.*, epochs, rest,
   md5('{mix.seed}:' || CAST(epochs AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place
   FROM d LEFT JOIN chosen USING (domain, lang, source)),
starts AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place
   RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS start FROM places)
SELECT doc_id, domain, lang, source, tokens,
   CAST(CASE WHEN epochs IS NULL THEN 0 ELSE epochs + CASE WHEN start < rest THEN 1 ELSE 0 END END AS BIGINT) AS copies
FROM starts
"""


SQL = mix_sql(PRODUCTION)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents"))
