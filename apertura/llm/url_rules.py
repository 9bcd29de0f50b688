"""URL filters by pattern rules that are indexed by their rarest literal token (operator 6).

A rule is a host, a path prefix (in which ``*`` stands for any run of characters) and a verdict. Its
tokens are the runs of letters and digits that any URL it fits must hold whole. Each rule is filed under
the one of its tokens that is rarest among the URLs; a URL's own tokens fetch candidate rules, and only
those run their regular expressions. Rules without such a token are candidates for every URL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        path = ".*".join(_quoted(x) for x in self.path.split("*"))
        return rf"(?s)\A(?:[^/?#]*\.)?{_quoted(self.host)}\x00{path}"

    def tokens(self) -> list[str]:
        whole = []
        for m in re.finditer("[a-z0-9]+", path := self.path.translate(str.maketrans(UPPER, LOWER))):
            if m.start() and m.end() < len(path) and "*" not in (path[m.start() - 1], path[m.end()]):
                whole.append(m[0])
        return re.findall("[a-z0-9]+", self.host) + whole


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


#: The rules that the query applies.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)
#: Rule sets up to this size travel inside the plan; larger ones are a table that is joined by token. Both are filed by the rarest token.
INLINE_RULES = 2000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """The distinct runs of ASCII letters and digits, in lower case."""
    return F.array_distinct(F.filter(F.split(F.translate(F.concat_ws("/", host, path), UPPER, LOWER), "[^a-z0-9]+"), lambda t: t != ""))


def rarest_tokens(parsed: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """The rules, of bounded number, by the token they are filed under; '' has those without one. Brings a count for each rule token to the driver."""
    words = sorted({t for rule in rules for t in rule.tokens()})
    counts = {}
    if words:
        hit = F.explode(F.array_intersect("__tokens", F.array(*map(F.lit, words)))).alias("t")
        counts = {r[0]: r[1] for r in parsed.select(hit).groupBy("t").count().collect()}
    filed: dict[str, list[Rule]] = {}
    for rule in rules:
        token = min(rule.tokens(), key=lambda t: (counts.get(t, 0), -len(t), t), default="")
        filed.setdefault(token, []).append(rule)
    return filed


def rule_index(spark: SparkSession, parsed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The rules as a table with the ``token`` each is filed under, counted among the URLs by joins; '' for those without one."""
    rows = [(k, r.tokens(), len(r.name), len(r.host), r.name, r.verdict, r.pattern) for k, r in enumerate(rules)]
    table = spark.createDataFrame(rows, "k long, tokens array<string>, len int, host_len int, rule string, verdict string, pattern string")
    named = table.select("k", F.explode("tokens").alias("t"))
    counts = parsed.select(F.explode("__tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).join(named.select("t").distinct(), "t", "left_semi")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("t")).alias("short"), "t"))["t"].alias("token")
    filed = named.join(counts, "t", "left").groupBy("k").agg(rarest)
    return table.join(filed, "k", "left").withColumn("token", F.coalesce("token", F.lit(""))).drop("k", "tokens")


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row.

    The longest fitting rule wins (of equal length, the longer host, then the larger name); a URL that no
    rule fits gets ``default``. A null URL or one without ``://`` has an empty host and path; very long URLs
    are read whole. Null or repeated page_ids are kept as they are; an empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    parsed = parsed.withColumn("__tokens", tokens_of(F.col("host"), F.col("path")))
    entry = lambda r: F.struct(
        F.lit(len(r.name)).alias("len"), F.lit(len(r.host)).alias("host_len"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern")
    )
    subject = F.concat("host", F.lit("\x00"), "path")
    if len(rules) <= INLINE_RULES:
        filed = rarest_tokens(parsed, rules)
        always = F.array(*map(entry, filed[""])) if "" in filed else None
        index = {t: rs for t, rs in filed.items() if t}
        found = always
        if index:
            lists = F.create_map(*[x for t, rs in index.items() for x in (F.lit(t), F.array(*map(entry, rs)))])
            fetched = F.flatten(F.transform(F.array_intersect("__tokens", F.array(*map(F.lit, index))), lambda t: lists[t]))
            found = fetched if always is None else F.concat(fetched, always)
        if found is None:
            best = F.lit(None).cast("struct<rule:string,verdict:string>")
        else:
            best = F.array_max(F.filter(found, lambda r: F.rlike(subject, r["pattern"])))
        out = parsed.withColumn("__best", best)
    else:
        out = _by_join(parsed, rule_index(pages.sparkSession, parsed, rules), subject)
    return out.select("page_id", "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))


def _by_join(parsed: DataFrame, index: DataFrame, subject: Column) -> DataFrame:
    """The same for many rules: URL tokens joined with the rule table, then the best rule of each distinct URL."""
    urls = parsed.select("host", "path", "__tokens").distinct()
    tokens = urls.withColumn("token", F.explode(F.array_union("__tokens", F.array(F.lit("")))))
    best = (
        tokens.join(index, "token")
        .where(F.rlike(subject, F.col("pattern")))
        .groupBy("host", "path")
        .agg(F.max(F.struct("len", "host_len", "rule", "verdict")).alias("__best"))
    )
    return parsed.join(best, ["host", "path"], "left")


URL_SQL = """
with u as (
  select page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
r(rhost, rpath, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                    ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
select u.page_id, u.host, u.path,
  (select rhost || rpath from r where (u.host = rhost or ends_with(u.host, '.' || rhost)) and starts_with(u.path, rpath)
   order by length(rhost || rpath) desc limit 1) as rule,
  coalesce((select verdict from r where (u.host = rhost or ends_with(u.host, '.' || rhost)) and starts_with(u.path, rpath)
   order by length(rhost || rpath) desc limit 1), 'allow') as verdict
from u
"""
