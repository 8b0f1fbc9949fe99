"""Secret scans: candidates by pattern, false positives removed by a random forest, all in SQL functions.

The forest is learned on the driver from a bounded set of labelled findings and turned into one SQL expression."""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ASSIGNED_TO = r"(?i:passw(?:or)?d|pwd|secret|token|api_?key)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?"
_VALUE = r"[^\s\"',;<>\x01\x02]{6,}"
#: Runs of 12 or more characters of secrets' alphabets with a digit among them (group 1), and whatever of 6 or more
#: characters is assigned to a secret's name (group 3, after the name and the sign in group 2). A run that ends in such a
#: name, with a value after it, gives way to the value; a sign belongs to a run only where nothing follows it.
CANDIDATE = (
    r"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*[0-9])(?![A-Za-z0-9_+/\-]*" + _ASSIGNED_TO + _VALUE + r")([A-Za-z0-9_+/\-]{12,}(?:={1,2}(?![^\s\"',;<>\x01\x02]))?)"
    r"|(" + _ASSIGNED_TO + ")(" + _VALUE + ")"
)
#: Characters of context on either side.
AROUND = 48

# Words that stand beside secrets, beside other numbers and digests, and in paths of sample files.
SECRET_WORDS = ("key", "token", "secret", "passw", "pwd", "auth", "credential", "bearer", "private", "apikey")
OTHER_WORDS = ("sha", "md5", "commit", "uuid", "checksum", "hash", "digest", "version", "build", "revision", "isbn", "order", "phone", "card", "http", "www")
SAMPLE_PATHS = ("test", "example", "sample", "mock", "fixture", "docs", "demo", "vendor", "lock")
# Frequent word parts; what they cover of a candidate speaks against a secret.
DICTIONARY = (
    "account", "action", "address", "admin", "after", "alpha", "apple", "archive", "array", "auto", "back", "base", "before", "begin", "beta", "black", "block", "board", "body", "build", "button", "cache", "call", "card", "case", "change", "chart",
    "check", "class", "click", "client", "close", "cloud", "code", "color", "column", "common", "config", "connect", "content", "control", "copy", "count", "create", "current", "data", "date", "default", "delete", "demo", "detail", "device", "dialog",
    "disable", "domain", "down", "draft", "edit", "element", "email", "enable", "error", "event", "example", "export", "field", "file", "filter", "final", "find", "first", "flag", "folder", "font", "form", "format", "frame", "from", "function", "game",
    "gallery", "global", "green", "group", "handler", "header", "height", "hidden", "home", "hour", "icon", "image", "import", "index", "info", "input", "insert", "item", "label", "language", "large", "last", "layer", "layout", "left", "level", "library",
    "light", "line", "link", "list", "load", "local", "lock", "login", "main", "manager", "map", "master", "media", "menu", "message", "method", "minute", "mobile", "model", "module", "month", "name", "network", "news", "next", "node", "note", "number",
    "object", "open", "option", "order", "output", "page", "panel", "parent", "part", "path", "photo", "player", "plugin", "point", "post", "price", "print", "product", "profile", "project", "public", "query", "record", "release", "remote", "report",
    "request", "response", "result", "right", "sample", "save", "screen", "script", "search", "section", "select", "server", "service", "session", "setting", "small", "source", "start", "state", "status", "string", "style", "system", "table", "target",
    "template", "test", "text", "time", "title", "total", "type", "update", "user", "value", "version", "video", "view", "width", "window", "with", "word",
)

FEATURES = ("n", "transitions", "distinct", "digits", "letters", "upper", "covered", "hexes", "near_secret", "near_other", "assigned", "quoted", "sample_path", "slashes", "dashes")


@dataclass(frozen=True)
class ForestParams:
    #: Labelled findings to learn from, at most; of a table of documents, so many are reviewed.
    max_findings: int = 4_000
    max_reviewed: int = 2_000
    trees: int = 25
    depth: int = 7
    least: int = 3
    seed: int = 13


def _any(words: tuple[str, ...]) -> str:
    return "(" + "|".join(words) + ")"


def features(found: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """Numbers that the forest decides on, from a candidate, the text on either side and the file's path."""
    n = F.length(found)
    near = F.lower(before)
    rest = F.regexp_replace(F.lower(found), _any(DICTIONARY), "")

    def share(pattern: str) -> Column:
        return F.regexp_count(found, F.lit(pattern)) / n

    def flag(x: Column) -> Column:
        return F.coalesce(x, F.lit(False)).cast("int")

    changes = "(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"
    out = {
        "n": n, "transitions": share(changes), "distinct": F.size(F.array_distinct(F.split(found, ""))) / n, "digits": share("[0-9]"), "letters": share("[A-Za-z]"), "upper": share("[A-Z]"), "covered": 1 - F.length(rest) / n,
        "hexes": share("[0-9a-f]"), "near_secret": flag(near.rlike(_any(SECRET_WORDS))), "near_other": flag(near.rlike(_any(OTHER_WORDS))), "assigned": flag(before.rlike("[=:]\\s*[\"']?$")), "quoted": flag(after.rlike("^[\"']")),
        "sample_path": flag(F.lower(path).rlike(_any(SAMPLE_PATHS))), "slashes": share("[/+]"), "dashes": share("[-_]"),
    }
    return {k: v.cast("double") for k, v in out.items()}


def _sums(x: Column) -> Column:
    """For an array of numbers 0 and the sums up to each element, by a fold."""
    return F.aggregate(x, F.array(F.lit(0)), lambda a, v: F.array_append(a, F.element_at(a, -1) + v))


def _starts(sizes: Column) -> Column:
    """Where each piece begins, from their sizes. Folds copy what they have so far at each step; so they run over groups of
    about the root of the number, and over the groups' sums."""
    n = F.size(sizes)
    each = F.ceil(F.sqrt(n)).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.ceil(n / each).cast("int") - 1), lambda g: F.slice(sizes, g * each + 1, each))
    ends = _sums(F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda a, v: a + v)))
    return F.flatten(F.transform(groups, lambda g, k: F.transform(F.slice(_sums(g), F.lit(1), F.size(g)), lambda v: v + F.get(ends, k))))


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """(id, start, found, before, after, path): one row for every candidate of every text; start counts characters from 0.

    Matches are marked with two control characters (which the text loses first, for spaces), the text is split at the
    first of them, and starts are summed up over the pieces. Of a text's pieces each candidate carries its own context only."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\x01\x02", "  ")
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), path.alias("path"), text.alias("text")).where(F.col("text").rlike(CANDIDATE))
    parts = rows.select("id", "path", F.split(F.regexp_replace("text", CANDIDATE, "$2\x01$1$3\x02"), "\x01").alias("parts"))
    # The first piece has no mark; every other one has the second mark and lost the first.
    parts = parts.select("*", F.transform("parts", lambda x, k: F.length(x) - F.when(k > 0, 1).otherwise(0)).alias("sizes"))
    parts = parts.select("id", "path", "parts", _starts(F.col("sizes")).alias("starts"))

    def one(k: Column) -> Column:
        piece, last, then = F.get("parts", k), F.get("parts", k - 1), F.coalesce(F.get("parts", k + 1), F.lit(""))
        # Context runs on into the neighbouring pieces, as far as they are one candidate away.
        after = F.concat(F.left(F.substring_index(piece, "\x02", -1), F.lit(AROUND)), F.left(F.translate(then, "\x02", ""), F.lit(AROUND)))
        return F.struct(
            F.get("starts", k).cast("long").alias("start"), F.substring_index(piece, "\x02", 1).alias("found"),
            F.right(F.translate(F.right(last, F.lit(AROUND + 1)), "\x02", ""), F.lit(AROUND)).alias("before"), F.left(after, F.lit(AROUND)).alias("after"),
        )

    found = parts.select("id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), one)).alias("p"))
    return found.select("id", "p.start", "p.found", "p.before", "p.after", "path")


#: What a reviewer goes by: formats of keys, and a value that is assigned to a secret's name outside of samples.
KEY_FORMAT = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}|xox[abp]-[0-9A-Za-z-]{20,}|sk_live_[0-9A-Za-z]{20,})$"
ASSIGNED = r"(?i)(passw(or)?d|pwd|secret|token|api_?key)[\"']?[ \t]*[=:][ \t]*[\"']?$"


def reviewed_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, p: ForestParams = ForestParams(), held_out: bool = False) -> list[dict]:
    """Findings of docs with the label that KEY_FORMAT and ASSIGNED give them: at most p.max_reviewed, the first by a hash.

    A stand-in for a reviewer, whose labels take its place in train(). Rows whose crc32(id as text) mod 5 is 0 are kept
    out, or are the only ones with held_out. Null text has no findings."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))
    found = candidates(docs.where(held if held_out else ~held), id_col, text_col, path_col)
    sure = F.col("found").rlike(KEY_FORMAT) | (F.col("before").rlike(ASSIGNED) & ~F.lower("path").rlike(_any(SAMPLE_PATHS)))
    order = [F.xxhash64(F.lit(p.seed), "id", "start", "found"), F.col("id"), F.col("start"), F.col("found")]
    rows = found.select("found", "before", "after", "path", sure.cast("int").alias("label"), "id", "start").orderBy(*order).limit(p.max_reviewed)
    return [r.asDict() for r in rows.drop("id", "start").collect()]


def grown(x: np.ndarray, y: np.ndarray, p: ForestParams, rng: np.random.Generator, depth: int = 0):
    """A tree as a share of secrets, or (feature, threshold, tree below or at it, tree above), by Gini impurity."""
    share = float(y.mean())
    if depth == p.depth or len(y) < 2 * p.least or share in (0.0, 1.0):
        return share
    best = (1e-9, None, None)
    for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        k = np.arange(1, len(y))
        left, right = t[:-1], t[-1] - t[:-1]
        ok = (v[1:] > v[:-1]) & (k >= p.least) & (len(y) - k >= p.least)
        if ok.any():
            impurity = left - left**2 / k + right - right**2 / (len(y) - k)
            gain = np.where(ok, len(y) * share * (1 - share) - impurity, -1)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], int(f), float((v[at] + v[at + 1]) / 2))
    if best[1] is None:
        return share
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grown(x[low], y[low], p, rng, depth + 1), grown(x[~low], y[~low], p, rng, depth + 1)


def forest(x: np.ndarray, y: np.ndarray, p: ForestParams) -> list:
    rng = np.random.default_rng(p.seed)
    picks = [rng.integers(0, len(y), len(y)) for _ in range(p.trees)] if len(y) else []
    return [grown(x[k], y[k], p, rng) for k in picks]


def as_sql(tree) -> str:
    if isinstance(tree, float):
        return f"{tree!r}D"
    f, at, low, high = tree
    return f"CASE WHEN `{FEATURES[f]}` <= {at!r}D THEN {as_sql(low)} ELSE {as_sql(high)} END"


def labelled_findings(n: int = 3_000, seed: int = 13) -> list[dict]:
    """Findings labelled by how they are made: keys and passwords in their usual places, and what looks like them.

    Stands in for a reviewed set of findings, which a user passes to train() instead."""
    r = random.Random(seed)
    hexes, base62 = "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    text = lambda a, k: "".join(r.choice(a) for _ in range(k))
    word = lambda: r.choice(DICTIONARY)
    prose = lambda: " ".join(text("aeinorst", r.randint(2, 8)) for _ in range(r.randint(2, 6))) + " "

    def row(found, before, after, label, path=None, digit=True):
        while digit and not any(c.isdigit() for c in found):
            found += r.choice("0123456789")
        return {"found": found, "before": (prose() + before)[-AROUND:], "after": (after + " " + prose())[:AROUND], "path": path or r.choice(["", "src0", "src/main", "app/config", "lib"]), "label": label}

    makers = [
        lambda: row("AKIA" + text(upper, 16), r.choice(["", "", "aws ", "key = ", "AWS_ACCESS_KEY_ID="]), "", 1),
        lambda: row(text(hexes, r.choice([32, 40, 64])), r.choice(["token", "api_key", "secret", "auth_token"]) + r.choice([' = "', ': "', '="']), '"', 1),
        lambda: row(text(hexes, r.randint(12, 24)), r.choice(["password", "passwd", "pwd", "PASSWORD"]) + r.choice(["=", ": ", " = "]), "", 1),
        lambda: row(text(base62, r.randint(20, 48)), r.choice(["secret", "token", "apikey", "client_secret", "bearer", "private_key"]) + r.choice(['="', ": ", " = '", "="]), r.choice(['"', "'", ""]), 1),
        lambda: row(r.choice(["ghp_", "xoxb-", "sk_live_"]) + text(base62, r.randint(24, 40)), r.choice(["", "token: ", "export TOKEN="]), "", 1),
        lambda: row(text(base62 + "._!@#%-", r.randint(7, 16)), r.choice(["password", "pwd", "passwd", "db_password", "secret"]) + r.choice(["=", ": ", " = '"]), "", 1, digit=False),
        lambda: row(r.choice(["required", word() + "." + word(), "<" + word() + ">", word() + "_" + word(), "******", "changeme", "os.environ", "None or ''"]), r.choice(["password", "token", "secret"]) + r.choice(["=", ": "]), "", 0, digit=False),
        lambda: row(text(hexes, 40), r.choice(["commit ", "revision ", "sha1 ", "checksum: "]), "", 0),
        lambda: row(text(hexes, r.choice([32, 64])), r.choice(["md5=", "sha256:", "digest ", "hash: "]), "", 0),
        lambda: row("-".join(text(hexes, k) for k in (8, 4, 4, 4, 12)), r.choice(["", "uuid ", "id: "]), "", 0),
        lambda: row(text("0123456789", r.randint(12, 19)), r.choice(["", "card ", "order ", "phone +", "isbn "]), r.choice(["", "."]), 0),
        lambda: row("_".join([word(), word(), word()]) + text("0123456789", r.randint(1, 4)), r.choice(["", "see ", "id="]), "", 0),
        lambda: row("/".join([word(), word(), text("0123456789", 4), word()]), r.choice(["http://www.", "path ", ""]), r.choice([".html", ".png", ""]), 0),
        lambda: row(text("0123456789", 4) + "-" + text("0123456789", 2) + "-" + text("0123456789", 2) + r.choice(["T12", "_build", "-v2"]), r.choice(["version ", "date ", ""]), "", 0),
        lambda: row(text("aeinorsthl", r.randint(10, 18)) + text("0123456789", r.randint(1, 3)), "", r.choice(["@mail", ".", "%"]), 0),
        lambda: row(text(base62, r.randint(20, 40)), r.choice(["token", "key", "password"]) + r.choice(["=", ": "]), "", 0, r.choice(["tests/fixtures", "docs/example", "mock/sample"])),
    ]
    return [makers[k % len(makers)]() for k in range(n)]


#: A table of findings that people judged: a candidate, the text on either side, the file's path, and 1 for a secret, else 0.
FINDINGS = "found string, before string, after string, path string, label int"


def to_judge(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, seed: int = 13) -> DataFrame:
    """A sample of n different candidates of docs, at most, as a FINDINGS table whose labels are null: for people to fill in."""
    found = candidates(docs, id_col, text_col, path_col).select("found", "before", "after", "path").distinct()
    order = [F.xxhash64(F.lit(seed), *found.columns), *map(F.col, found.columns)]
    return found.orderBy(*order).limit(n).withColumn("label", F.lit(None).cast("int"))


def findings_of(table: DataFrame, p: ForestParams = ForestParams()) -> list[dict]:
    """What train() takes, from a FINDINGS table: at most p.max_findings of its judged rows, the first by a hash.

    Rows without a candidate or a label are left out; null context and paths are empty; a label that is neither 0 nor 1
    is an error; an empty table gives an empty list. More columns may follow."""
    rows = _judged(table).orderBy(F.xxhash64(F.lit(p.seed), "found", "before", "after", "path"), "found", "before", "after", "path", "label")
    return [r.asDict() for r in rows.limit(p.max_findings).collect()]


def _judged(table: DataFrame) -> DataFrame:
    near = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("before", "after", "path")]
    known = table.where("found IS NOT NULL AND label IS NOT NULL")
    label = F.when(F.col("label").isin(0, 1), F.col("label").cast("int")).otherwise(F.raise_error(F.lit("a label is 0 or 1")).cast("int"))
    return known.select("found", *near, label.alias("label"))


def agreement(table: DataFrame, expression: str) -> DataFrame:
    """(findings, secrets, taken, agreed, precision, recall) of the forest's verdicts against the labels of a FINDINGS table.

    taken: findings that the forest takes for secrets; agreed: those of them that are. A share of nothing is null."""
    columns = features(F.col("found"), F.col("before"), F.col("after"), F.col("path"))
    rows = _judged(table).select("label", *[columns[f].alias(f) for f in FEATURES])
    taken = (F.expr(expression) >= 0.5).cast("long")
    sums = rows.select("label", taken.alias("taken")).agg(
        F.count("*").alias("findings"), F.coalesce(F.sum("label"), F.lit(0)).alias("secrets"), F.coalesce(F.sum("taken"), F.lit(0)).alias("taken"),
        F.coalesce(F.sum(F.col("taken") * F.col("label")), F.lit(0)).alias("agreed"),
    )
    share = lambda of: F.when(F.col(of) > 0, F.col("agreed") / F.col(of))
    return sums.select("*", share("taken").alias("precision"), share("secrets").alias("recall"))


def train(spark: SparkSession, findings: list[dict] | None = None, p: ForestParams = ForestParams()) -> str:
    """The forest as an SQL expression over FEATURES: the mean of its trees' shares.

    findings: found, before, after, path, label (1: a secret); the first p.max_findings of them count. Their features
    are computed by the same expressions that scan() uses. Without findings the expression is 0.5."""
    findings = (labelled_findings() if findings is None else findings)[: p.max_findings]
    if not findings:
        return "0.5D"
    schema = "array<struct<found:string,before:string,after:string,path:string,label:int>>"
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(findings)), schema)).alias("r")).select("r.*")
    columns = features(F.col("found"), F.col("before"), F.col("after"), F.col("path"))
    got = rows.select(*[columns[f].alias(f) for f in FEATURES], "label").collect()
    x = np.array([[r[f] for f in FEATURES] for r in got])
    trees = forest(x, np.array([float(r["label"]) for r in got]), p)
    return "(" + " + ".join(as_sql(t) for t in trees) + f") / {len(trees)}"


def scan(docs: DataFrame, expression: str, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(id, start, length, digest, score, is_secret): every candidate of every row of docs, with the forest's verdict.

    digest is the candidate's SHA-256, so that results hold no secrets. Null text has no candidates; a null path is
    empty; rows repeated are scanned each; an empty table gives an empty result. No rows are shuffled."""
    found = candidates(docs, id_col, text_col, path_col)
    columns = features(F.col("found"), F.col("before"), F.col("after"), F.col("path"))
    rows = found.select("id", "start", F.length("found").cast("long").alias("length"), F.sha2("found", 256).alias("digest"), *[columns[f].alias(f) for f in FEATURES])
    scored = rows.withColumn("score", F.expr(expression))
    return scored.select("id", "start", "length", "digest", "score", (F.col("score") >= 0.5).alias("is_secret"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with its verdict; see scan for nulls, empty texts, repeated rows and empty tables.

    The forest learns from at most ForestParams.max_reviewed findings of the documents and as many generated ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    p = ForestParams()
    findings = reviewed_findings(docs, path_col="source", p=p) + labelled_findings(p.max_reviewed)
    return scan(docs, train(spark, findings, p), path_col="source").withColumnRenamed("id", "doc_id")
