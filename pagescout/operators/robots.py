"""robots.txt rules as tables (R1-R4, J2, J5, X2), after RFC 9309.

Input: ``robots(host, status, body)``, one row per host. A robots file is bounded (crawlers
read at most 500 KiB), so the window over its lines and the array of its rules are too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescout import settings as S
from pagescout.functions import urls as U
from pagescout.functions.steps import count_up_to, settle
from pagescout.operators.skew import lookup_join

_AGENT, _ALLOW, _DISALLOW, _DELAY = "user-agent", "allow", "disallow", "crawl-delay"


def robots_lines(robots: DataFrame) -> DataFrame:
    """``(host, pos, field, value, group_no)``: the lines that carry rules, with their group.

    A group starts at a User-agent line that follows a line of another kind; consecutive
    User-agent lines share the rules after them.
    """
    text = F.regexp_replace(F.col("line"), "#.*$", "")
    is_agent = F.col("field") == _AGENT
    in_order = Window.partitionBy("host").orderBy("pos")
    starts = is_agent & ~F.coalesce(F.lag(is_agent).over(in_order), F.lit(False))
    return (
        robots.where(status_policy(F.col("status")) == "parse")
        .select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("pos", "line"))
        .select(
            "host",
            "pos",
            F.lower(U.trim_space(F.regexp_extract(text, "^([^:]*):", 1))).alias("field"),
            U.trim_space(F.regexp_replace(text, "^[^:]*:?", "")).alias("value"),
        )
        .where(F.col("field").isin(_AGENT, _ALLOW, _DISALLOW, _DELAY))
        .withColumn("starts", starts)
        .withColumn("group_no", F.sum(F.col("starts").cast("int")).over(in_order))
        .where(F.col("group_no") > 0)
        .drop("starts")
    )


def _with_agents(lines: DataFrame, agents: list[str] | None) -> DataFrame:
    """The non-agent lines, once for each agent of their group."""
    named = lines.where(F.col("field") == _AGENT).select(
        "host", "group_no", F.lower("value").alias("agent")
    )
    if agents is not None:
        named = named.where(F.col("agent").isin(agents))
    rules = lines.where(F.col("field") != _AGENT)
    return rules.join(named.distinct(), ["host", "group_no"])


def robots_rules(robots: DataFrame, agents: list[str] | None = None) -> DataFrame:
    """``(host, agent, allow, path, path_len)``.

    An empty Disallow states that everything is allowed and therefore gives no rule.
    ``agents`` restricts the result to some agents before the join.
    """
    rules = _with_agents(robots_lines(robots), agents)
    return (
        rules.where(F.col("field").isin(_ALLOW, _DISALLOW) & (F.col("value") != ""))
        .select("host", "agent", (F.col("field") == _ALLOW).alias("allow"), F.col("value").alias("path"))
        .distinct()
        .withColumn("path_len", F.length("path"))
    )


def robots_delays(robots: DataFrame, agents: list[str] | None = None) -> DataFrame:
    """``(host, agent, delay_s)``; the largest value where a group states several."""
    rules = _with_agents(robots_lines(robots), agents)
    return (
        rules.where(F.col("field") == _DELAY)
        .withColumn("delay_s", F.expr("try_cast(value AS DOUBLE)"))
        .where(F.col("delay_s") > 0)
        .groupBy("host", "agent")
        .agg(F.max("delay_s").alias("delay_s"))
    )


def status_policy(status: Column) -> Column:
    """``parse`` for 2xx, ``disallow_all`` for 5xx, else ``allow_all``."""
    return (
        F.when(status.between(200, 299), "parse")
        .when(status.between(500, 599), "disallow_all")
        .otherwise("allow_all")
    )


def product_token(agent: str) -> str:
    """The name by which robots files call an agent: its text before the first slash."""
    return agent.split("/")[0].strip().lower()


def agent_group(robots: DataFrame, token: str = S.USER_AGENT_TOKEN) -> DataFrame:
    """R2: ``(host, agent)``, the agent whose groups apply to us on each host.

    Our own token when the file names it, else ``*``; hosts with neither are left out. A whole
    agent string may be given, of which only the token counts.
    """
    name = product_token(token)
    return (
        robots_lines(robots)
        .where(F.col("field") == _AGENT)
        .where(F.lower("value").isin(name, "*"))
        .groupBy("host")
        .agg(F.max(F.lower("value") == name).alias("named"))
        .select("host", F.when(F.col("named"), name).otherwise("*").alias("agent"))
    )


def host_policy(robots: DataFrame, token: str = S.USER_AGENT_TOKEN) -> DataFrame:
    """``(host, policy, rules, delay_s)``: all that decides about URLs, one row per host.

    The lines are read once: agents, rules and delays of a group come from the same rows, and the
    groups of a host, which one bounded file holds, are chosen from in place.
    """
    name = product_token(token)
    is_agent, value = F.col("field") == _AGENT, F.col("value")
    is_rule = F.col("field").isin(_ALLOW, _DISALLOW) & (value != "")
    rule = F.struct(
        F.length(value).alias("path_len"), (F.col("field") == _ALLOW).alias("allow"), U.escape_rule_path(value).alias("path")
    )
    delay = F.when(F.col("field") == _DELAY, F.expr("try_cast(value AS DOUBLE)"))
    groups = (
        robots_lines(robots)
        .groupBy("host", "group_no")
        .agg(
            F.collect_set(F.when(is_agent, F.lower(value))).alias("agents"),
            F.collect_set(F.when(is_rule, rule)).alias("rules"),
            F.max(F.when(delay > 0, delay)).alias("delay_s"),
        )
        .groupBy("host")
        .agg(F.collect_list(F.struct("agents", "rules", "delay_s")).alias("groups"))
    )
    named = F.exists("groups", lambda g: F.array_contains(g["agents"], name))
    agent = F.when(named, F.lit(name)).otherwise(F.lit("*"))
    ours = settle(
        groups.withColumn("agent", agent).select(
            "host", F.filter("groups", lambda g: F.array_contains(g["agents"], F.col("agent"))).alias("ours")
        ),
        "ours",
    )
    per_host = ours.where(F.size("ours") > 0).select(
        "host",
        F.array_distinct(F.flatten(F.transform("ours", lambda g: g["rules"]))).alias("rules"),
        F.array_max(F.transform("ours", lambda g: g["delay_s"])).alias("delay_s"),
    )
    return robots.select("host", status_policy(F.col("status")).alias("policy")).join(
        per_host, "host", "left"
    )


def path_and_query(url: Column) -> Column:
    """The part of a URL that robots rules are about."""
    path = U.url_path(url)
    return F.concat(F.when(path == "", "/").otherwise(U.escape_path(path)), U.url_query(url))


def rule_index(policy: DataFrame) -> DataFrame:
    """A policy whose ``rules`` are laid out for lookups, one row per host as before.

    ``plain`` and ``exact`` are sorted rules without wild cards (``exact`` ones ended in ``$``), ``lengths`` the
    lengths of plain paths; ``wild`` has the rules with ``*``, cut at it, the strongest rule first.
    """
    rules = F.coalesce("rules", F.array().cast(policy.schema["rules"].dataType))

    def path(r: Column) -> Column:
        return F.regexp_replace(r["path"], r"\$$", "")

    def entry(r: Column) -> Column:
        return F.struct(path(r).alias("path"), r["path_len"].alias("path_len"), r["allow"].alias("allow"))

    def wild(r: Column) -> Column:
        return F.struct(
            r["path_len"].alias("path_len"), r["allow"].alias("allow"),
            F.split(path(r), r"\*").alias("pieces"), r["path"].endswith("$").alias("anchored"),
        )

    literal = F.filter(rules, lambda r: ~r["path"].contains("*"))
    plain = F.filter(literal, lambda r: ~r["path"].endswith("$"))
    return policy.select(
        "host",
        "policy",
        F.array_sort(F.transform(plain, entry)).alias("plain"),
        F.array_sort(F.transform(F.filter(literal, lambda r: r["path"].endswith("$")), entry)).alias("exact"),
        F.array_distinct(F.transform(plain, lambda r: F.length(r["path"]))).alias("lengths"),
        F.sort_array(F.transform(F.filter(rules, lambda r: r["path"].contains("*")), wild), asc=False).alias("wild"),
        "delay_s",
    )


def wild_matches(target: Column, pieces: Column, anchored: Column) -> Column:
    """Whether the pieces stand in the target in this order, the first at its start, the last at its end if ``anchored``.

    Each piece is taken at its first place behind the piece before it; that leaves most room for the rest, so
    nothing is tried twice.
    """
    last = F.element_at(pieces, -1)
    between = F.slice(pieces, 2, F.greatest(F.size(pieces) - F.when(anchored, 2).otherwise(1), F.lit(0)))

    def behind(at: Column, piece: Column) -> Column:
        found = F.position(piece, target, at)
        return F.when((at == 0) | (piece == ""), at).when(found == 0, 0).otherwise(found + F.length(piece))

    at = F.aggregate(between, F.length(pieces[0]) + 1, behind)
    room = (at > 0) & (~anchored | (target.endswith(last) & (F.length(target) - F.length(last) + 1 >= at)))
    return target.startswith(pieces[0]) & room


def _lookup(entries: Column, key: Column) -> Column:
    """The strongest entry with this path in entries sorted by path, by halving; NULL without one."""
    count = count_up_to(entries, key, lambda e: e["path"])
    hit = F.filter(F.slice(entries, F.greatest(count, F.lit(1)), 1), lambda e: e["path"] == key)
    return F.transform(hit, lambda e: F.struct(e["path_len"].alias("path_len"), e["allow"].alias("allow")))


def allowed_by(target: Column) -> Column:
    """The longest matching rule of a :func:`rule_index` decides, Allow wins a tie, no rule means allowed.

    Plain rules cost one lookup for each length that the rules of the host have, not one comparison a rule.
    """
    strength = "struct<path_len: int, allow: boolean>"
    fitting = F.filter("lengths", lambda n: n <= F.length(target))
    plain = F.flatten(F.transform(fitting, lambda n: _lookup(F.col("plain"), F.left(target, n))))
    exact = _lookup(F.col("exact"), target)
    wild = F.aggregate(
        "wild",
        F.lit(None).cast(strength),
        lambda best, r: F.when(best.isNotNull(), best).when(
            wild_matches(target, r["pieces"], r["anchored"]), F.struct(r["path_len"].alias("path_len"), r["allow"].alias("allow"))
        ),
    )
    best = F.array_max(F.concat(plain, exact, F.array(wild)))
    return F.when(F.col("policy") == "disallow_all", False).otherwise(F.coalesce(best["allow"], F.lit(True)))


def robots_verdict(
    urls: DataFrame,
    policy: DataFrame,
    default_delay: float = S.CRAWL_DELAY_SECONDS,
    **join_options,
) -> DataFrame:
    """Adds ``host``, ``allowed`` and ``delay_s`` to a table with a ``url`` column.

    ``policy`` comes from :func:`host_policy` or :func:`rule_index`. Hosts without a robots file allow everything.
    The rules of a host arrive as one array, so the join keeps the number of rows.
    """
    keep = [c for c in urls.columns if c != "host"]
    placed = urls.withColumns(
        {"host": U.url_host(F.col("url")), "_target": path_and_query(F.col("url"))}
    )
    indexed = policy if "lengths" in policy.columns else rule_index(policy)
    joined = lookup_join(placed, indexed, "host", **join_options)
    judged = joined.select(
        *keep,
        "host",
        allowed_by(F.col("_target")).alias("allowed"),
        F.coalesce(F.col("delay_s"), F.lit(float(default_delay))).alias("delay_s"),
    )
    return settle(judged, "allowed")


def robots_allowed(judged: DataFrame) -> DataFrame:
    """P5: the URLs that may be fetched."""
    return judged.where(F.col("allowed"))


def robots_excluded(judged: DataFrame) -> DataFrame:
    """The URLs that were visited but must not be fetched."""
    return judged.where(~F.col("allowed"))
