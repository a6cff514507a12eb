"""Secrets in texts, and credentials whose parts stand in different places: DataFrame functions only.

A credential is an identifier, a secret and often an endpoint. Some parts give themselves away (a key with a known beginning, a value that is
assigned to a password); others, such as a user name or a host, are no finding by themselves. Those are reported only where what completes them
stands in the same scope, a block of text between blank lines, and near enough.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from string import ascii_letters, digits, hexdigits

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_column, written

#: Characters between the parts of one credential, and in a bucket of the join of parts with scopes.
REACH, BUCKET = 400, 1024


def _either_case(words: str) -> str:
    """Alternatives in the order given, letters in either case (A-Z and a-z only, unlike a flag of some engines)."""
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in words.split())


def _assigned(words: str, value: str, begin: str = "()") -> str:
    return rf"""{begin}(?:{_either_case(words)})["']?\x20*[:=]\x20*["']?([{value}]+)"""


_OWN_WORD = "(^|[^A-Za-z0-9])"
#: Words to which a value is assigned.
_WORDS = {
    "assign": "password passwd secret token api_?key",
    "name": "username user_id userid user login account client_id access_?key_?id",
    "phrase": "passphrase passcode pass pwd private_?key access_?key credential auth",
    "place": "hostname host server endpoint database bucket url",
}
#: Kinds in the order of their spans, each with role, pattern (group 1: what lies before the span, group 2: the value), and the least length of the value. The first three are findings by themselves.
KINDS = {
    "assign": ("secret", _assigned(_WORDS["assign"], "A-Za-z0-9+/_.=-"), 6),
    "access": ("identifier", "()(AKIA[A-Z0-9]{16,})", 20),
    "hex": ("secret", "()([0-9a-f]{24,})", 24),
    "name": ("identifier", _assigned(_WORDS["name"], "A-Za-z0-9+/_.@=-", _OWN_WORD), 3),
    "phrase": ("secret", _assigned(_WORDS["phrase"], "A-Za-z0-9+/_.=-", _OWN_WORD), 6),
    "opaque": ("secret", "()([A-Za-z0-9+/]{40,})", 40),
    "place": ("endpoint", _assigned(_WORDS["place"], "A-Za-z0-9_./:@-", _OWN_WORD), 3),
    "link": ("endpoint", rf"""{_OWN_WORD}([A-Za-z][A-Za-z0-9+.-]{{0,15}}://[^\x00-\x20"'<>]+)""", 6),
}
STRONG = ("assign", "access", "hex")
#: What separates scopes.
BREAK = r"()(\n[\x20\t\r]*\n[\x20\t\r\n]*)"
_NAMES = list(KINDS)


def _may_hold(text: Column, name: str) -> Column:
    """Whether a text can have matches of a kind: false only if it has none, and much less work than its pattern, which tries all words at each character."""
    if name in _WORDS:
        # from the sign back: a word, with up to eight spaces between, or more spaces than that
        return text.rlike(rf"""[:=](?<=(?:{_either_case(_WORDS[name])})["']?\x20{{0,8}}[:=]|\x20{{9}}[:=])""")
    # each sign by itself: the regex engine looks one up in a table, but tries ranges one after the other
    return {"access": text.contains("AKIA"), "hex": text.rlike(f"[{hexdigits[:16]}]{{24}}"), "opaque": text.rlike(f"[{ascii_letters}{digits}+/]{{40}}"), "link": text.contains("://")}[name]


def _places(text: Column, kind: int, pattern: str, when: Column) -> Column:
    """All matches as (kind, gap since the match before, size, lead, value length), in order; what lies between matches gives their places. None where not `when`."""
    # no pattern looks beyond its match, so groups are found again in the matches, without another pass over the text
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.length(m).alias("size"), *[F.length(F.regexp_extract(m, pattern, g)).alias(n) for g, n in ((1, "lead"), (2, "value"))]))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.zip_with(sizes, F.slice(gaps, 1, F.size(gaps) - 1), lambda x, gap: F.struct(F.lit(kind).alias("kind"), gap.alias("gap"), x["size"], x["lead"], x["value"]))
    return F.when(when, zipped).otherwise(F.expr("cast(array() as array<struct<kind: int, gap: int, size: int, lead: int, value: int>>)"))


def _scanned(docs: DataFrame) -> DataFrame:
    """One pass over the texts: row, doc_id, n_chars, found. Blank lines are looked for only beside parts that depend on others."""
    every = docs.select("doc_id", text_column()).select("doc_id", "text", F.length("text").alias("n_chars"), *[_places(F.col("text"), k, KINDS[name][1], _may_hold(F.col("text"), name)).alias(name) for k, name in enumerate(_NAMES)])
    weak = reduce(or_, [F.size(name) > 0 for name in _NAMES if name not in STRONG])
    breaks = _places(F.col("text"), len(KINDS), BREAK, weak)
    return written(every.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", F.concat(*_NAMES, breaks).alias("found")), "credential-parts")


def _parts(scanned: DataFrame) -> DataFrame:
    """Each match with its place: row, kind, start, stop (code points, end exclusive), value."""
    rows = scanned.where(F.size("found") > 0).select("row", F.posexplode("found").alias("i", "x")).select("row", "i", "x.*")
    until = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("i"))
    return rows.select("row", "kind", "value", until.alias("stop"), (until - F.col("size") + F.col("lead")).alias("start"))


def _with_scopes(parts: DataFrame, breaks: DataFrame, scanned: DataFrame) -> DataFrame:
    """Parts joined with the scope that they start in: by row and bucket of places, then by interval."""
    first = scanned.select("row", F.lit(0).cast("long").alias("start"))
    starts = first.unionByName(breaks.select("row", F.col("stop").alias("start")))
    ends = F.lead("start").over(Window.partitionBy("row").orderBy("start"))
    scopes = starts.select("row", F.col("start").alias("scope"), ends.alias("scope_end")).join(scanned.select("row", F.col("n_chars").cast("long").alias("n")), "row")
    scopes = scopes.select("row", "scope", F.coalesce("scope_end", F.col("n") + 1).alias("scope_end"))
    buckets = scopes.withColumn("bucket", F.explode(F.expr(f"sequence(scope div {BUCKET}, (scope_end - 1) div {BUCKET})")))
    found = parts.withColumn("bucket", F.expr(f"start div {BUCKET}")).join(buckets, ["row", "bucket"])
    return found.where("scope <= start and start < scope_end").select(*parts.columns, "scope")


def linked_parts(scanned: DataFrame) -> DataFrame:
    """The reported parts of scanned documents: row, kind, role, start, stop.

    assign, access and hex are reported wherever they are. A weak identifier is reported near a secret, a weak secret near an identifier, if that
    other part is a strong one or an endpoint is near too; an endpoint near an identifier and a secret of which one is strong. Near: in the same scope, at most
    REACH characters away. A weak identifier or secret that overlaps a strong part is that part, and isn't reported again.
    """
    parts = _parts(scanned)
    known = F.create_map(*[F.lit(x) for k, name in enumerate(_NAMES) for x in (k, KINDS[name][0])])
    least = F.create_map(*[F.lit(x) for k, name in enumerate(_NAMES) for x in (k, KINDS[name][2])])
    strong = F.col("kind") < len(STRONG)
    spans = parts.where((F.col("kind") < len(KINDS)) & (F.col("value") >= least[F.col("kind")])).select("row", "kind", "start", "stop", known[F.col("kind")].alias("role"), strong.alias("strong"))
    spans = written(spans, "spans")
    weak = spans.where("not strong").select("row").distinct()
    beside = written(spans.join(weak, "row", "left_semi"), "spans-to-link")
    rows = scanned.join(weak, "row", "left_semi")
    placed = _with_scopes(beside, parts.where(F.col("kind") == len(KINDS)).join(weak, "row", "left_semi"), rows)
    scope = Window.partitionBy("row", "scope")
    back, ahead = (scope.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for order in (("start", "kind"), (F.desc("start"), F.desc("kind"))))
    of = {"identifier": F.col("role") == "identifier", "secret": F.col("role") == "secret", "endpoint": F.col("role") == "endpoint"}
    of |= {"strong_identifier": of["identifier"] & F.col("strong"), "strong_secret": of["secret"] & F.col("strong"), "strong": F.col("strong")}
    placed = placed.withColumns({f"{name}_before": F.max(F.when(test, F.col("stop"))).over(back) for name, test in of.items()})
    placed = placed.withColumns({f"{name}_after": F.min(F.when(test, F.col("start"))).over(ahead) for name, test in of.items()})

    def near(name: str, reach: int = REACH) -> Column:
        return F.coalesce(F.col("start") - F.col(f"{name}_before") <= reach, F.lit(False)) | F.coalesce(F.col(f"{name}_after") - F.col("stop") <= reach, F.lit(False))

    role = F.col("role")
    reported = (
        F.when(role == "identifier", near("secret") & (near("strong_secret") | near("endpoint")) & ~near("strong", -1))
        .when(role == "secret", near("identifier") & (near("strong_identifier") | near("endpoint")) & ~near("strong", -1))
        .otherwise(near("identifier") & near("secret") & (near("strong_identifier") | near("strong_secret")))
    )
    columns = ["row", "kind", "role", "start", "stop"]
    return spans.where("strong").select(columns).unionByName(placed.where(~F.col("strong") & reported).select(columns))


def credentials(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text; others are left out): doc_id, n_assign, n_access, n_hex, base_sha256, spans, and the spans as an array of (kind, role, start, stop).

    Each row is judged by its own text, also where several have one doc_id or none; null and empty texts have no spans. No Python runs on executors.
    """
    scanned = _scanned(docs)
    name = F.element_at(F.array(*map(F.lit, _NAMES)), F.col("kind") + 1)
    parts = linked_parts(scanned).withColumn("name", name)
    listed = F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "name", "role")))
    count = [F.count(F.when(F.col("name") == kind, 1)).alias(f"n_{kind}") for kind in STRONG]
    found = parts.groupBy("row").agg(listed.alias("parts"), *count)
    rows = scanned.select("row", "doc_id").join(found, "row", "left")
    def texts(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda p: F.concat_ws(":", p["name"], p["start"].cast("string"), p["stop"].cast("string"))), ",")

    parts = F.coalesce("parts", F.expr("cast(array() as array<struct<start: bigint, kind: int, stop: bigint, name: string, role: string>>)"))
    base = F.filter(parts, lambda p: p["kind"] < len(STRONG))
    return rows.select(
        "doc_id", *[F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in STRONG],
        F.sha2(texts(base), 256).alias("base_sha256"), texts(parts).alias("spans"), F.transform(parts, lambda p: F.struct(p["name"].alias("kind"), p["role"], p["start"], p["stop"])).alias("parts"),
    )
