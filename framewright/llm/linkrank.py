"""URL filter: rules first, then trust and distrust propagated over the link graph between hosts; DataFrame functions only.

A rule (host, path, verdict) fits a host and its subdomains where the url's path starts with the rule's; the longest wins. Where
no rule fits, the host decides: personalised PageRank from the hosts of allowed pages along links gives trust, the
same from the hosts of blocked pages against the links gives distrust, and a host is blocked if its share of trust, trust / (trust +
distrust), is below ``SHARE``. A host that neither reaches is allowed.

Links are counted once a page and combined before the shuffle; links inside a host move nothing. Ranks are tables of one row a host,
written each round, until the ranks move by less than ``STILL`` in sum; cycles and long chains settle too.

Defined results: a null url or one without :// has an empty host and path, fits no rule and is allowed unless host '' is
blocked by rank, which it never is; null html has no links; repeated pages count each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import drop_written, written

RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Each round moves at most ``DAMPING`` of what the one before moved, so ``ROUNDS`` rounds always come to ``STILL``.
DAMPING, ROUNDS, STILL, SHARE = 0.85, 150, 1e-9, 0.5
#: Rounds of the SQL form.
SQL_ROUNDS = 40
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links between different hosts, w pages each."""
    host, _ = host_and_path(F.col("url"))
    target = lambda link: F.when(link.contains("://"), host_and_path(link)[0]).when(link.startswith("//"), host_and_path(F.concat(F.lit("x:"), link))[0])
    links = pages.select(host.alias("src"), F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), target)).alias("dsts"))
    each = links.where("src <> ''").select("src", F.explode_outer("dsts").alias("dst")).where("dst is not null and dst <> '' and dst <> src")
    return each.groupBy("src", "dst").agg(F.count("*").alias("w"))


def host_ranks(pages: DataFrame, rules=RULES) -> DataFrame:
    """(host, trust, distrust) of each host that has pages or links."""
    host, path = host_and_path(F.col("url"))
    verdict = rule_of(F.col("host"), F.col("path"), rules)[1]
    seeds = pages.select(host.alias("host"), path.alias("path")).where("host <> ''").groupBy("host").agg(F.count_if(verdict == "allow").alias("good"), F.count_if(verdict == "block").alias("bad"))
    links = written(host_links(pages), "links")
    out = links.groupBy("src").agg(F.sum("w").alias("total"))
    back = links.groupBy("dst").agg(F.sum("w").alias("total"))
    along = written(links.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")), "along")
    against = written(links.join(back, "dst").select("src", "dst", (F.col("w") / F.col("total")).alias("p")), "against")
    every = seeds.select("host").unionByName(links.select(F.explode(F.array("src", "dst")).alias("host"))).distinct()
    total = seeds.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).select(*[F.greatest(F.coalesce(c, F.lit(0)), F.lit(1)).alias("all_" + c) for c in ("good", "bad")]).first()
    share = lambda c: (1 - DAMPING) * F.coalesce(c, F.lit(0)) / total["all_" + c]
    base = written(every.join(seeds, "host", "left").select("host", share("good").alias("trust0"), share("bad").alias("distrust0")), "seeds")
    ranks = base.select("host", F.col("trust0").alias("trust"), F.col("distrust0").alias("distrust"))
    for _ in range(ROUNDS):
        t = along.join(ranks, along.src == ranks.host).groupBy("dst").agg(F.sum(F.col("trust") * F.col("p")).alias("t"))
        d = against.join(ranks, against.dst == ranks.host).groupBy("src").agg(F.sum(F.col("distrust") * F.col("p")).alias("d"))
        step = base.join(t, base.host == t.dst, "left").join(d, base.host == d.src, "left").join(ranks.select("host", F.col("trust").alias("t_old"), F.col("distrust").alias("d_old")), "host")
        moved = lambda start, x: F.col(start) + DAMPING * F.coalesce(x, F.lit(0.0))
        new = written(step.select("host", moved("trust0", "t").alias("trust"), moved("distrust0", "d").alias("distrust"), "t_old", "d_old"), "ranks")
        change = new.agg(F.sum(F.abs(F.col("trust") - F.col("t_old")) + F.abs(F.col("distrust") - F.col("d_old")))).first()[0]
        drop_written(ranks)
        ranks = new.select("host", "trust", "distrust")
        ranks._written_at = new._written_at
        if not change or change < STILL:
            break
    return ranks


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages`` (page_id, url, html)."""
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ranks = host_ranks(pages, rules)
    both = F.col("trust") + F.col("distrust")
    hosts = ranks.select("host", F.when((both > 0) & (F.col("trust") < SHARE * both), "block").otherwise("allow").alias("by_host"))
    rows = pages.select(F.col("page_id").cast("bigint"), host.alias("host"), path.alias("path")).withColumns({"rule": rule, "by_rule": verdict})
    return rows.join(hosts, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"))


def oracle_sql() -> str:
    """The same in DuckDB SQL, with a fixed number of rounds."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    where = lambda u: f"translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    link = LINK.replace("'", "''")
    rounds = "".join(
        f""", r{k + 1} as materialized (select b.host, b.trust + {DAMPING} * coalesce(t.x, 0) as trust, b.distrust + {DAMPING} * coalesce(d.x, 0) as distrust
  from r0 b left join (select dst, sum(r.trust * a.p) as x from along a join r{k} r on r.host = a.src group by dst) t on t.dst = b.host
  left join (select src, sum(r.distrust * a.p) as x from against a join r{k} r on r.host = a.dst group by src) d on d.src = b.host)"""
        for k in range(SQL_ROUNDS)
    )
    return f"""
with rules(h, p, v) as (values {rules}),
u as materialized (select page_id, coalesce({where('url')}, '') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, html from pages),
urls as materialized (select distinct host, path from u),
fit as materialized (select urls.host, urls.path, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v
  from urls join rules on (urls.host = h or ends_with(urls.host, '.' || h)) and starts_with(urls.path, p) group by all),
seeds as materialized (select host, count(*) filter (v = 'allow') as good, count(*) filter (v = 'block') as bad from u left join fit using (host, path) where host <> '' group by host),
found as (select host as src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda x: case when contains(x, '://') then {where('x')} when starts_with(x, '//') then {where("('x:' || x)")} end))) as dst from u where host <> ''),
links as materialized (select src, dst, count(*) as w from found where dst is not null and dst <> '' and dst <> src group by all),
along as materialized (select src, dst, w / sum(w) over (partition by src) as p from links),
against as materialized (select src, dst, w / sum(w) over (partition by dst) as p from links),
every as (select host from seeds union select src from links union select dst from links),
total as (select greatest(coalesce(sum(good), 0), 1) as g, greatest(coalesce(sum(bad), 0), 1) as b from seeds),
r0 as materialized (select host, {1 - DAMPING} * coalesce(good, 0) / g as trust, {1 - DAMPING} * coalesce(bad, 0) / b as distrust from every left join seeds using (host), total){rounds}
select page_id, host, path, rule, coalesce(v, case when trust + distrust > 0 and trust < {SHARE} * (trust + distrust) then 'block' end, 'allow') as verdict
from u left join fit using (host, path) left join r{SQL_ROUNDS} using (host)
"""
