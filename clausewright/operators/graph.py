"""Counterparty networks: control, connected groups, exposures and limits."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import chain, round_half_up

c = F.col
#: More than this share of ownership is control; from these on, it is influence and a large holding.
CONTROL, INFLUENCE, HOLDER = 50, 20, 10


def usable(edges: DataFrame, include_flagged: bool = False) -> DataFrame:
    """Edges that count: rebutted ones never, flagged ones on request."""
    return edges.where((c("status") != "rebutted") & ((c("status") != "flagged") | F.lit(include_flagged)))


def control_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Who controls whom directly; sovereigns control nobody here."""
    sovereign = entities.where("entity_type = 'sovereign'").select(c("entity_id").alias("from_entity"))
    strong = edges.where((c("edge_type") == "CONTROLS") | ((c("edge_type") == "OWNS") & (c("pct") > CONTROL)))
    return strong.where("from_entity <> to_entity").join(sovereign, "from_entity", "left_anti").select("from_entity", "to_entity").distinct()


def _cut(df: DataFrame, label: str) -> DataFrame:
    """df written to the folder that all executors share, and read again: lineage ends there."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or "/tmp/checkpoints/clausewright"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def closure(pairs: DataFrame) -> DataFrame:
    """All (from_entity, to_entity) that a chain of pairs joins; cycles end. Each round joins what is known
    with itself, so chains of any length close in as many rounds as their length has binary digits."""
    known = _cut(pairs.select("from_entity", "to_entity").distinct(), "closure")
    size = known.count()
    while True:
        further = known.select(c("from_entity").alias("to_entity"), c("to_entity").alias("next"))
        longer = known.join(further, "to_entity").select("from_entity", c("next").alias("to_entity"))
        known = _cut(known.union(longer).distinct(), "closure")
        before, size = size, known.count()
        if size == before:
            return known


def ultimate_controllers(control: DataFrame, reach: DataFrame) -> DataFrame:
    """root, member: controllers that nobody controls with all they reach. Of a cycle that no root reaches,
    the least controller stands for all."""
    owners = control.select(c("from_entity").alias("root")).distinct()
    top = owners.join(control.select(c("to_entity").alias("root")), "root", "left_anti")
    below = reach.select(c("from_entity").alias("root"), c("to_entity").alias("member"))
    covered = below.join(top, "root", "left_semi").select("member").distinct()
    loose = owners.join(covered, c("root") == c("member"), "left_anti").join(top, "root", "left_anti")
    mutual = below.join(loose, "root", "left_semi")
    # A loose controller starts a group unless a lesser loose one reaches it.
    lesser = mutual.join(loose.select(c("root").alias("member")), "member", "left_semi").where("root < member").select(c("member").alias("root")).distinct()
    roots = top.union(loose.join(lesser, "root", "left_anti"))
    return below.join(roots, "root", "left_semi").union(roots.select("root", c("root").alias("member"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the least node that each node of an undirected graph reaches."""
    both = _cut(edges.select(c(a).alias("u"), c(b).alias("v")).union(edges.select(b, a)).distinct(), "components")
    label = _cut(both.groupBy(c("u").alias("node")).agg(F.least(F.min("v"), c("u")).alias("root")), "components")
    while True:
        near = both.join(label, c("v") == c("node")).groupBy("u").agg(F.min("root").alias("low"))
        better = label.join(near, c("node") == c("u"), "left").select("node", F.least("root", F.coalesce("low", "root")).alias("root"))
        jump = better.join(label.select(c("node").alias("_n"), c("root").alias("_r")), c("root") == c("_n"), "left")
        after = _cut(jump.select("node", F.least("root", F.coalesce("_r", "root")).alias("root")), "components")
        if not after.join(label, ["node", "root"], "left_anti").limit(1).count():
            return after
        label = after


def merge_common_management(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Control groups (root, member) joined where common management links their members."""
    ties = edges.where("edge_type = 'COMMON_MANAGEMENT'").select(c("from_entity").alias("a"), c("to_entity").alias("b"))
    inside = groups.select(c("root").alias("a"), c("member").alias("b"))
    return components(ties.union(inside)).select("root", c("node").alias("member"))


def spread_dependence(groups: DataFrame, edges: DataFrame, reach: DataFrame) -> DataFrame:
    """Groups (root, member) extended to a fixpoint: whoever depends on a member joins every group of that
    member, with all it controls; a provider without a group opens one."""
    dependent = edges.where("edge_type = 'ECONOMIC_DEPENDENCE'")
    one_way = dependent.select(c("from_entity").alias("joins"), c("to_entity").alias("member"))
    pairs = one_way.union(dependent.where("bidirectional").select(c("to_entity").alias("joins"), c("from_entity").alias("member"))).where("joins <> member").distinct()
    alone = pairs.select("member").distinct().join(groups.select("member"), "member", "left_anti").select(c("member").alias("root"), "member")
    known = _cut(groups.select("root", "member").union(alone).distinct(), "groups")
    below = reach.select(c("from_entity").alias("joins"), c("to_entity").alias("also"))
    pulled = pairs.union(pairs.join(below, "joins").select(c("also").alias("joins"), "member"))
    # Whoever joins brings its own dependents along: what a member pulls in, in the end, is a closure.
    ends = closure(pulled.select(c("member").alias("from_entity"), c("joins").alias("to_entity")))
    reached = known.join(ends, c("member") == c("from_entity")).select("root", c("to_entity").alias("member"))
    return known.union(reached).distinct()


def numbered_groups(groups: DataFrame) -> DataFrame:
    """group_id (G1 the largest), root, members (sorted), size of groups of two or more that no larger or
    earlier group contains."""
    sets = groups.groupBy("root").agg(F.sort_array(F.collect_set("member")).alias("members")).withColumn("size", F.size("members")).where("size > 1")
    by_member = sets.select("root", "size", "members", F.explode("members").alias("m"))
    other = by_member.select(c("root").alias("o_root"), c("size").alias("o_size"), "m")
    shared = by_member.select("root", "size", "m").join(other, "m").where("root <> o_root").groupBy("root", "size", "o_root", "o_size").agg(F.count(F.lit(1)).alias("k"))
    inside = shared.where((c("k") == c("size")) & ((c("o_size") > c("size")) | ((c("o_size") == c("size")) & (c("o_root") < c("root")))))
    kept = sets.join(inside.select("root").distinct(), "root", "left_anti")
    place = F.row_number().over(Window.orderBy(c("size").desc(), "root"))
    return kept.withColumn("group_id", F.concat(F.lit("G"), place.cast("string")))


def connected_groups(edges: DataFrame, entities: DataFrame, include_flagged: bool = False) -> DataFrame:
    """Control, then common management, then dependence: group_id, root, members, size."""
    live = usable(edges, include_flagged)
    control = control_edges(live, entities)
    reach = closure(control)
    merged = merge_common_management(_cut(ultimate_controllers(control, reach), "controllers"), live)
    return numbered_groups(_cut(spread_dependence(merged, live, reach), "groups"))


def aggregate_exposures(exposures: DataFrame, entities: DataFrame, limit_or_outstanding: bool = False) -> DataFrame:
    """Net exposure to each counterparty. What credit protection covers counts against its provider; exempt
    amounts (a given reason, or a sovereign) are kept apart and count against no limit."""
    sovereign = entities.where("entity_type = 'sovereign'").select(c("entity_id").alias("_s"))
    amount = F.coalesce("amount", F.lit(0))
    value = F.greatest(amount, F.coalesce("sanctioned", F.lit(0))) if limit_or_outstanding else amount
    x = exposures.withColumn("value", value).withColumn("crm", F.least(F.greatest(F.coalesce("crm", F.lit(0)), F.lit(0)), c("value"))).withColumn("net", F.greatest(c("value") - c("crm"), F.lit(0)))
    own = x.select("entity_id", c("net").alias("part"), c("exempt_reason").isNotNull().alias("exempt"), "infrastructure", F.coalesce("kind", F.lit("fund_based")).alias("kind"), "board_approved", F.lit(0).cast("long").alias("received"))
    moved = x.where("crm > 0 AND crm_provider IS NOT NULL").select(c("crm_provider").alias("entity_id"), c("crm").alias("part"), F.lit(False).alias("exempt"), F.lit(False).alias("infrastructure"), F.lit("crm_substitution").alias("kind"), F.lit(False).alias("board_approved"), c("crm").alias("received"))
    legs = own.unionByName(moved).join(sovereign, c("entity_id") == c("_s"), "left").withColumn("exempt", c("exempt") | c("_s").isNotNull())
    counts = lambda when: F.coalesce(F.sum(F.when(when, c("part"))), F.lit(0))
    return legs.groupBy("entity_id").agg(
        counts(~c("exempt")).alias("total"),
        counts(c("exempt")).alias("exempt"),
        counts(~c("exempt") & c("infrastructure")).alias("infrastructure"),
        counts(~c("exempt") & (c("kind") == "equity")).alias("equity"),
        F.sum("received").alias("crm_received"),
        F.bool_or("board_approved").alias("board_approved"),
    )


def counterparty_classes(entities: DataFrame) -> DataFrame:
    """entity_id, cls, rank: the classes under which an entity's limit is looked for, the closest first."""
    nbfc = c("entity_type") == "nbfc"
    lists = chain(
        [
            (nbfc & c("gold_loan"), F.array(*map(F.lit, ("gold_nbfc", "nbfc", "default")))),
            (nbfc, F.array(*map(F.lit, ("nbfc", "default")))),
            (c("entity_type") == "bank", F.array(*map(F.lit, ("bank", "default")))),
        ],
        F.array(F.lit("default")),
    )
    return entities.select("entity_id", F.posexplode(lists).alias("rank", "cls"))


def pick_limit(classes: DataFrame, limits: dict[str, float]) -> DataFrame:
    """entity_id, cls, limit_pct: the limit of the closest class that has one."""
    table = classes.sparkSession.createDataFrame(list(limits.items()), "cls string, limit_pct double")
    first = F.min_by(F.struct("cls", "limit_pct"), "rank").alias("x")
    return classes.join(F.broadcast(table), "cls").groupBy("entity_id").agg(first).select("entity_id", "x.cls", "x.limit_pct")


def limit_check(rows: DataFrame, amount: str, base: float | None, limit: Column, infra_extension: float = 0, board_extension: float = 0, cap: float | None = None) -> DataFrame:
    """Status, percentages and headroom of each row's amount against a limit in percent of a capital base.

    Columns infrastructure (an amount) and board_approved extend the limit where the rule allows it.
    """
    if not base or base <= 0:
        return rows.withColumn("status", F.lit("NEEDS_REVIEW"))
    pct = c(amount) / base * 100
    infra = F.when(c("infrastructure") > 0, F.least(F.lit(float(infra_extension)), c("infrastructure") / base * 100)).otherwise(0.0)
    extended = limit + infra + F.when(c("board_approved"), float(board_extension)).otherwise(0.0)
    extended = F.least(extended, F.lit(float(cap))) if cap else extended
    allowed = F.when(pct <= limit, limit).otherwise(extended)
    status = chain([(pct <= limit, F.lit("PASS")), (pct <= extended, F.lit("PASS_WITH_CONDITIONS"))], F.lit("BREACH"))
    return rows.select("*", status.alias("status"), round_half_up(pct).alias("exposure_pct"), round_half_up(allowed).alias("allowed_pct"), round_half_up(allowed / 100 * base - c(amount)).alias("headroom"))


def group_exposure(groups: DataFrame, totals: DataFrame) -> DataFrame:
    """Group sums of the members' rounded totals; infrastructure unrounded."""
    members = groups.select("group_id", F.explode("members").alias("entity_id"))
    return members.join(totals, "entity_id").groupBy("group_id").agg(F.sum(round_half_up(c("total"))).alias("total"), F.sum("infrastructure").alias("infrastructure"))


def own_group(edges: DataFrame, self_id: int) -> DataFrame:
    """entity_id, relation of a bank's own group; the first relation that holds wins: owned, parent, sibling."""
    owned = edges.where((c("from_entity") == self_id) & (((c("edge_type") == "OWNS") & (c("pct") >= INFLUENCE)) | (c("edge_type") == "CONTROLS"))).select(c("to_entity").alias("entity_id"), F.lit(1).alias("turn"), F.lit("subsidiary_or_associate").alias("relation"))
    parents = edges.where((c("to_entity") == self_id) & (((c("edge_type") == "OWNS") & (c("pct") >= INFLUENCE)) | (c("edge_type") == "CONTROLS"))).select(c("from_entity").alias("entity_id"), F.lit(2).alias("turn"), F.lit("parent_or_promoter").alias("relation"))
    held = edges.where((c("edge_type") == "OWNS") & (c("pct") >= INFLUENCE)).join(parents.select(c("entity_id").alias("from_entity")), "from_entity", "left_semi").select(c("to_entity").alias("entity_id"), F.lit(3).alias("turn"), F.lit("held_by_parent").alias("relation"))
    every = owned.union(parents).union(held).where(c("entity_id") != self_id)
    return every.groupBy("entity_id").agg(F.min_by("relation", "turn").alias("relation"))


def edge_sentence() -> Column:
    """An edge in words."""
    a, b = c("from_entity").cast("string"), c("to_entity").cast("string")
    say = lambda middle: F.concat(a, F.lit(middle), b)
    return chain(
        [
            (c("edge_type") == "OWNS", F.concat(a, F.lit(" holds "), c("pct").cast("int").cast("string"), F.lit("% of "), b)),
            (c("edge_type") == "CONTROLS", say(" controls ")),
            (c("edge_type") == "COMMON_MANAGEMENT", say(" shares its management with ")),
            (c("edge_type") == "ECONOMIC_DEPENDENCE", say(" depends on ")),
            (c("edge_type") == "DIRECTOR_OF", say(" is a director of ")),
        ],
        say(" is related to "),
    )


def restricted_parties(edges: DataFrame, entities: DataFrame, self_id: int) -> DataFrame:
    """entity_id, reason, hops: directors, their relatives and companies, holders of a tenth or more and what
    they hold a fifth of. The shorter way to a party replaces the longer one."""
    directors = edges.where((c("edge_type") == "DIRECTOR_OF") & (c("to_entity") == self_id)).select(c("from_entity").alias("p"), F.lit("director").alias("reason"), F.lit(1).alias("hops"))
    holders = edges.where((c("edge_type") == "OWNS") & (c("pct") >= HOLDER) & (c("to_entity") == self_id)).select(c("from_entity").alias("p"), F.lit("holder").alias("reason"), F.lit(1).alias("hops"))
    first = directors.unionByName(holders)
    kin = edges.where("edge_type = 'RELATIVE_OF'")
    both = kin.select("from_entity", "to_entity").union(kin.select("to_entity", "from_entity"))
    relatives = first.join(both, c("p") == c("from_entity")).select(c("to_entity").alias("p"), F.lit("relative").alias("reason"), F.lit(2).alias("hops"))
    persons = first.unionByName(relatives)
    held = edges.where(((c("edge_type") == "OWNS") & (c("pct") >= INFLUENCE)) | (c("edge_type") == "DIRECTOR_OF"))
    firms = persons.join(held, c("p") == c("from_entity")).select(c("to_entity").alias("p"), F.lit("firm").alias("reason"), (c("hops") + 1).alias("hops"))
    known = entities.select(c("entity_id").alias("p"))
    every = persons.unionByName(firms).where(c("p") != self_id).join(known, "p", "left_semi")
    return every.groupBy(c("p").alias("entity_id")).agg(F.min_by(F.struct("reason", "hops"), F.struct("hops", "reason")).alias("x")).select("entity_id", "x.reason", "x.hops")


def capital_base(base: Column, tier1: Column, tier2: Column, owned: Column, paid_up: Column) -> Column:
    """The capital that a limit is measured by; null where the base is unknown or its figure missing."""
    return chain(
        [
            (base == "tier1", tier1),
            (base == "capital_funds", tier1 + F.coalesce(tier2, F.lit(0))),
            (base == "owned_funds", owned),
            (base.isin("paid_up_capital_reserves", "capital_fund_rcb"), paid_up),
        ],
        F.lit(None).cast("double"),
    )


def provisional_only(with_flagged: DataFrame, confirmed: DataFrame, members: str = "members") -> DataFrame:
    """Groups that exist only with flagged links: those whose sorted members are no confirmed group's."""
    return with_flagged.join(confirmed.select(members).distinct(), members, "left_anti")


def related_party_verdicts(hits: DataFrame) -> DataFrame:
    """A verdict for each related party with an exposure: PROHIBITED, or NEEDS_REVIEW where the rule is not verified, the
    relation is flagged only, or an exception is claimed; and the hops of the shortest path that counts.

    hits: party, exposure, hops, verified, flagged_only, exception, a row for each path.
    """
    sums = hits.where("exposure > 0").groupBy("party").agg(
        F.bool_and("verified").alias("verified"),
        F.bool_and("flagged_only").alias("provisional"),
        F.max("exception").alias("exception"),
        F.coalesce(F.min(F.when(~F.col("flagged_only"), F.col("hops"))), F.min("hops")).alias("hops"),
    )
    review = ~F.col("verified") | F.col("provisional") | F.col("exception").isNotNull()
    return sums.withColumn("status", F.when(review, "NEEDS_REVIEW").otherwise("PROHIBITED"))


def group_checks(edges: DataFrame, entities: DataFrame, exposures: DataFrame, base: float, default: float, nbfc: float) -> DataFrame:
    """Group limits: each confirmed group with an exposure against the rule for NBFCs, if a member is one, or the default;
    groups that exist only with flagged links are told of only where they would breach it, as POTENTIAL_BREACH."""
    sums = aggregate_exposures(exposures, entities)
    confirmed = connected_groups(edges, entities)
    extra = provisional_only(connected_groups(edges, entities, include_flagged=True), confirmed)
    groups = confirmed.withColumn("provisional", F.lit(False)).unionByName(extra.withColumn("provisional", F.lit(True)))
    groups = _cut(groups.select("group_id", "root", "members", "provisional"), "group_checks")
    member = groups.select("root", "provisional", F.explode("members").alias("entity_id"))
    parts = member.join(entities.select("entity_id", "entity_type"), "entity_id").join(sums.select("entity_id", "total"), "entity_id", "left")
    totals = parts.groupBy("root", "provisional").agg(F.sum(F.coalesce("total", F.lit(0))).alias("total"), F.bool_or(F.col("entity_type") == "nbfc").alias("has_nbfc")).where("total > 0")
    limit = F.when(F.col("has_nbfc"), F.lit(nbfc)).otherwise(F.lit(default))
    share = F.col("total") / base * 100
    breach = share > limit
    status = F.when(breach & F.col("provisional"), "POTENTIAL_BREACH").when(breach, "BREACH").otherwise("PASS")
    checked = totals.withColumn("limit_pct", limit).withColumn("exposure_pct", round_half_up(share)).withColumn("status", status)
    checked = checked.where(~F.col("provisional") | (F.col("status") == "POTENTIAL_BREACH"))
    return groups.select("group_id", "root", "provisional", "members").join(checked, ["root", "provisional"])
