"""URL filters: pattern rules found by their rarest literal token.

A pattern is text with ``*`` (anything), ``^`` (a character other than a letter or digit, or an end),
``||`` before a host (which may follow subdomains) and ``|`` at an end of the URL. Its literal tokens,
runs of ASCII letters and digits with a literal neighbour or ``^`` or ``|`` at both sides, must all
stand in a URL that it fits as tokens of that URL. So each rule is listed under the one of its tokens
that the corpus holds least often, and a URL's tokens fetch the few rules whose regular expressions
run on it. Rules without such a token run on every URL.

Rules of a counted size are shipped to the tasks, and URLs are judged without a shuffle. Beyond that
size distinct URLs meet the rules in a join on the token.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import map_rows
from tallyframe.session import materialise

RULES = "rule string, pattern string, action string, scope string, tier int"
# Rules go to every task up to so many of so many bytes together.
SHIPPED_RULES = 200_000
SHIPPED_BYTES = 32 << 20
TOKEN = "[A-Za-z0-9]+"
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def site_rule(rule: str, action: str) -> tuple[str, str, str, str, int]:
    """Row of a rule like ``example.com/en/``: a host with its subdomains and the start of a path."""
    return rule, f"||{rule}", action, "url", 1


def pattern_rule(pattern: str, action: str, scope: str = "url") -> tuple[str, str, str, str, int]:
    """Row of a pattern over the whole URL behind ``://`` (``url``) or its host only (``host``)."""
    return pattern, pattern, action, scope, 0


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host with A-Z lower-cased, path, and the rest; empty where there is no ``://``."""
    at = F.instr(url, "://")
    behind = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(behind, "^([^/?#]*)", 1), *LETTERS)
    path = F.regexp_extract(behind, "^[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(behind, r"(?s)^[^?#]*(.*)$", 1)
    return tuple(F.coalesce(part, F.lit("")) for part in (host, path, rest))


def expression(pattern: str) -> str:
    """Regular expression of a pattern, to be searched."""
    start = end = ""
    if pattern.startswith("||"):
        start, pattern = r"\A(?:[^/?#]*\.)?", pattern[2:]
    elif pattern.startswith("|"):
        start, pattern = r"\A", pattern[1:]
    if pattern.endswith("|"):
        end, pattern = r"\Z", pattern[:-1]
    signs = {"*": "(?s:.*)", "^": r"(?:\A|\Z|[^A-Za-z0-9])"}
    return start + "".join(signs.get(c) or re.escape(c) for c in pattern) + end


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that every URL which the pattern fits holds as whole tokens."""
    open_start, open_end = not pattern.startswith("|"), not pattern.endswith("|")
    body = pattern.strip("|")
    found = set()
    for match in re.finditer(TOKEN, body):
        before = body[match.start() - 1] if match.start() else "*" * open_start
        after = body[match.end()] if match.end() < len(body) else "*" * open_end
        if before != "*" and after != "*":
            found.add(match.group())
    return sorted(found)


def _prepared(urls: DataFrame, key: str) -> DataFrame:
    host, path, rest = parts(F.col("u"))
    return urls.select(F.col(key).alias("k"), F.col("url").cast("string").alias("u")).select(
        "k", "u", host.alias("host"), path.alias("path"), rest.alias("rest")
    )


def _tokens(prepared: DataFrame) -> Column:
    whole = F.concat("host", "path", "rest")
    return F.explode(F.array_distinct(F.regexp_extract_all(whole, F.lit(f"({TOKEN})"))))


def index_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with the ``token`` they are listed under: the one that the fewest URLs hold, of equally
    rare ones the longest; null without a literal token. ``urls`` has host, path and rest.

    Rules without a pattern go, repeated ones count once, and where the same pattern allows and
    blocks, both stay (allowing wins when they are judged).
    """
    wanted = rules.select(*[f.split()[0] for f in RULES.split(", ")]).where(
        F.col("pattern").isNotNull()
    )
    listed = map_rows(
        wanted.distinct(),
        RULES + ", tokens array<string>",
        lambda: lambda batch: {name: batch[name] for name in batch.schema.names}
        | {"tokens": [literal_tokens(p) for p in batch["pattern"].to_pylist()]},
    )
    listed = materialise(listed)
    own = listed.select(F.explode("tokens").alias("token")).distinct()
    # counted before they meet the rules, so a token that most URLs hold moves as one row a task
    held = (
        urls.select(_tokens(urls).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("held_by"))
        .join(own, "token", "left_semi")
    )
    columns = [f.split()[0] for f in RULES.split(", ")]
    rarity = F.struct(
        F.coalesce("held_by", F.lit(0)).alias("held_by"), -F.length("token"), F.col("token").alias("token")
    )
    return (
        listed.select(*columns, F.explode_outer("tokens").alias("token"))
        .join(held, "token", "left")
        .groupBy(*columns)
        .agg(F.min(F.when(F.col("token").isNotNull(), rarity)).alias("rarest"))
        .select(*columns, F.col("rarest.token").alias("token"))
    )


def _worth(rule) -> tuple:
    """Order of rules that fit: tier, length, allowing before blocking, then the text."""
    return -rule.tier, -len(rule.pattern), rule.action != "allow", rule.rule


FITTING = "k {kind}, u string, host string, path string, rule string, action string, tier int"


def judge(urls: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """The best rule that fits each URL: ``key``, url, host, path, rule, action, tier.

    ``rules`` has the columns of ``RULES``. Of several rules the higher tier wins, then the longer
    pattern, then one that allows, then the first by text. Null URLs and those without ``://`` have
    an empty host and path and are fitted by patterns of the empty text only; URLs without a fitting
    rule have null rule, action and tier. Every row is judged, repeated rows and null keys too; an
    empty table gives no rows, and without rules nothing fits. Other columns are left out.
    """
    prepared = _prepared(urls, key)
    index = materialise(index_rules(prepared, rules))
    size = index.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.length("pattern") + F.length("rule")), F.lit(0)).alias("bytes"),
    ).first()
    fits = _shipped if size.n <= SHIPPED_RULES and size.bytes <= SHIPPED_BYTES else _joined
    return fits(prepared, index).select(
        F.col("k").alias(key), F.col("u").alias("url"), "host", "path", "rule", "action", "tier"
    )


class Matcher:
    """Regular expressions of rules, compiled when first run."""

    def __init__(self):
        self.compiled = {}

    def fits(self, pattern: str, scope: str, host: str, whole: str) -> bool:
        found = self.compiled.get(pattern)
        if found is None:
            found = self.compiled[pattern] = re.compile(expression(pattern))
        return found.search(host if scope == "host" else whole) is not None


def _shipped(prepared: DataFrame, index: DataFrame) -> DataFrame:
    """Judge in the task that reads the URLs."""
    spark = prepared.sparkSession
    rules = sorted(index.collect(), key=_worth)
    shipped = spark.sparkContext.broadcast([tuple(r) for r in rules])
    kind = prepared.schema["k"].dataType.simpleString()

    def make():
        rules = shipped.value
        by_token, always = {}, []
        for place, (*_, token) in enumerate(rules):
            (always if token is None else by_token.setdefault(token, [])).append(place)
        matcher, tokens_of = Matcher(), re.compile(TOKEN)

        def work(batch):
            hosts, paths, rests = (batch[c].to_pylist() for c in ("host", "path", "rest"))
            best = []
            for host, path, rest in zip(hosts, paths, rests):
                whole = host + path + rest
                places = set(always)
                for token in tokens_of.findall(whole):
                    places.update(by_token.get(token, ()))
                best.append(
                    next(
                        (rules[p] for p in sorted(places)
                         if matcher.fits(rules[p][1], rules[p][3], host, whole)),
                        (None,) * 6,
                    )
                )
            out = {name: batch[name] for name in ("k", "u", "host", "path")}
            out["rule"], _, out["action"], _, out["tier"], _ = zip(*best)
            return out

        return work

    return map_rows(prepared, FITTING.format(kind=kind), make)


def _joined(prepared: DataFrame, index: DataFrame) -> DataFrame:
    """Judge distinct URLs by a join with the rules on the token, then give all rows their rule."""
    texts = prepared.where(F.col("u").isNotNull()).select("u", "host", "path", "rest").distinct()
    everywhere = index.where(F.col("token").isNull()).drop("token")
    found = texts.select("u", "host", "path", "rest", _tokens(texts).alias("token")).join(
        index, "token"
    )
    candidates = found.select("u", "host", "path", "rest", "rule", "pattern", "action", "scope", "tier")

    def make():
        matcher = Matcher()

        def work(batch):
            rows = batch.to_pydict()
            fits = [
                matcher.fits(pattern, scope, host, host + path + rest)
                for pattern, scope, host, path, rest in zip(
                    *(rows[c] for c in ("pattern", "scope", "host", "path", "rest"))
                )
            ]
            return {c: rows[c] for c in ("u", "rule", "pattern", "action", "tier")} | {"fits": fits}

        return work

    schema = "u string, rule string, pattern string, action string, tier int, fits boolean"
    fitting = map_rows(candidates, schema, make).where("fits")
    order = F.struct(
        (-F.col("tier")).alias("tier"), (-F.length("pattern")).alias("size"),
        (F.col("action") != "allow").alias("blocks"), F.col("rule").alias("rule"),
    )
    best = fitting.groupBy("u").agg(F.min(F.struct(order.alias("order"), "action")).alias("best"))
    by_token = prepared.join(best, "u", "left").select(
        "k", "u", "host", "path", "rest",
        F.col("best.order.rule").alias("rule"), F.col("best.action").alias("action"),
        (-F.col("best.order.tier")).alias("tier"), (-F.col("best.order.size")).alias("size"),
    )
    return _with_rules_for_all(by_token, everywhere)


def _with_rules_for_all(judged: DataFrame, everywhere: DataFrame) -> DataFrame:
    """Let rules without a token run on every URL; such rules must be few enough to be shipped."""
    size = everywhere.count()
    if size > SHIPPED_RULES:
        raise ValueError(f"{size} rules without a literal token would each run on every URL")
    rules = sorted(everywhere.collect(), key=_worth)
    shipped = judged.sparkSession.sparkContext.broadcast(rules)
    kind = judged.schema["k"].dataType.simpleString()

    def make():
        matcher, rules = Matcher(), shipped.value

        def work(batch):
            rows = batch.to_pydict()
            out = {c: rows[c] for c in ("k", "u", "host", "path")}
            best = []
            for host, path, rest, *held in zip(
                *(rows[c] for c in ("host", "path", "rest", "rule", "action", "tier", "size"))
            ):
                rule, action, tier, length = held
                worth = (-tier, -length, action != "allow", rule) if rule is not None else None
                for other in rules:
                    if worth is not None and worth <= _worth(other):
                        break
                    if matcher.fits(other.pattern, other.scope, host, host + path + rest):
                        rule, action, tier = other.rule, other.action, other.tier
                        break
                best.append((rule, action, tier))
            out["rule"], out["action"], out["tier"] = zip(*best)
            return out

        return work

    return map_rows(judged, FITTING.format(kind=kind), make)
