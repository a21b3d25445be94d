"""Column functions over text: normal forms, noise rules, redaction, entropy, tokens."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}]+"
#: Secrets and what stands for them, replaced in this order.
SECRET_PATTERNS = (
    (r"sk-[A-Za-z0-9_-]{20,}", "[REDACTED_API_KEY]"),
    (r"AKIA[0-9A-Z]{16}", "[REDACTED_AWS_KEY]"),
    (r"AIzaSy[A-Za-z0-9_-]{33}", "[REDACTED_GOOGLE_KEY]"),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (r"(?i)Bearer\s+[A-Za-z0-9._-]{24,}", "Bearer [REDACTED_BEARER_TOKEN]"),
    (r"(?:postgres|mysql|mongodb|redis)://[^\s\"']+", "[REDACTED_CONNECTION_STRING]"),
    (r"(?i)(?:password|secret|api_key|token)\s*[:=]\s*['\"][^'\"]{4,}['\"]", "secret=[REDACTED_SECRET]"),
)
#: Folders that name a user.
PATH_PATTERNS = (
    (r"[A-Za-z]:\\(?:Users|Documents|AppData)\\[^\s\"';:]+", "[WORKSPACE_ROOT]/path"),
    (r"/(?:home|Users)/[^\s\"';:]+", "[WORKSPACE_ROOT]/path"),
)
#: Words that tell a repair from a redesign.
HOTFIX_WORDS = "fix bug error panic crash revert regression failure broken hotfix patch issue fragile".split()
REFACTOR_WORDS = "refactor architecture migrate design structure decouple module lineage dependency extract topo".split()
#: Marks of a memory that another one replaces.
OBSOLETE_WORDS = ("deprecated", "obsoleto", "antiguo", "no usar")
#: What opens a prohibition, and words in it that aren't terms.
PROHIBITIONS = ("never use ", "never ", "do not use ", "do not ", "prohibited ", "evitar ", "forbidden ")
STOP_TERMS = "the a an for to in on with and or use using rule standard point".split()


def tokens(text: Column, least: int = 1) -> Column:
    """Lower-case letter and digit runs of at least ``least`` characters, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= least) if least > 1 else found


def strip(text: Column) -> Column:
    """Without ASCII white space at the ends."""
    return F.regexp_replace(text, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def collapse(text: Column) -> Column:
    """Trimmed, runs of ASCII white space as one space."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def normalized_hash(text: Column) -> Column:
    """sha256 of the collapsed lower-case text: equal for texts that differ in case or white space."""
    return F.sha2(F.lower(collapse(text)), 256)


def topic_key(text: Column) -> Column:
    """Lower case, anything but a-z, 0-9, '/' and '-' as one '-', none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9/]+", "-"), r"^-+|-+$", "")


def module_of(path: Column) -> Column:
    """Module of a path: its first folder below a container folder and a source folder; 'root' for files at the top."""
    parts = F.filter(F.split(relative_path(path), "/"), lambda p: (p != "") & (p != "."))
    p0 = F.lower(F.get(parts, 0))
    n = F.size(parts)
    skip = F.when(p0.isin("crates", "packages", "apps", "services", "libs", "modules") & (n > 1), 1).when(p0.isin("backend", "frontend", "api") & (n > 2), 1).otherwise(0)
    r0 = F.get(parts, skip)
    inner = F.lower(r0).isin("src", "app", "lib") & (n - skip > 1)
    return F.when(n <= 1, "root").when(inner, F.get(parts, skip + 1)).otherwise(r0)


def subsystem_of(path: Column) -> Column:
    """First folder, or the first two below a workspace folder; 'root' for files at the top."""
    parts = F.filter(F.split(relative_path(path), "/"), lambda p: p != "")
    wide = F.get(parts, 0).isin("crates", "python", "src", "packages", "apps", "services", "modules") & (F.size(parts) > 2)
    return F.when(F.size(parts) <= 1, "root").when(wide, F.concat_ws("/", F.get(parts, 0), F.get(parts, 1))).otherwise(F.get(parts, 0))


def topic_of(text: Column) -> Column:
    """The first three words of four letters or more, joined by '-'."""
    return F.array_join(F.slice(tokens(text, 4), 1, 3), "-")


def relative_path(path: Column) -> Column:
    """Forward slashes, no leading './' or '/', no doubled slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/{2,}", "/"), r"^(\./|/)+", "")


def table_name(name: Column) -> Column:
    """Last part of a qualified name without quotes, lower case."""
    return F.lower(F.regexp_replace(F.element_at(F.split(name, r"\."), -1), r"[\"`\[\]']", ""))


def endpoint_path(path: Column) -> Column:
    """Canonical route: from '/api/' on, no query, parameters as ':id', no slash at the end."""
    bare = F.regexp_replace(F.trim(path), r"(?s)[?#].*$", "")
    bare = F.regexp_replace(bare, r"\$\{(?:API_URL|NEXT_PUBLIC_API_URL|BASE_URL|API_BASE)\}", "")
    bare = F.regexp_replace(bare, r"(?s)^.*?(?=/api/)", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\$?\{[^}]+\}", ":id"), "/+$", "")


def tree_path(path: Column) -> Column:
    """A file path as a dotted label path of letters, digits and '_'."""
    return F.regexp_replace(F.regexp_replace(relative_path(path), "/", "."), r"[^A-Za-z0-9_.]", "_")


def noise_reason(text: Column) -> Column:
    """Why a text isn't worth remembering, by the first rule that holds; 'CLEAN' if it is."""
    t = strip(F.coalesce(text, F.lit("")))
    fences = F.regexp_count(t, F.lit("```"))
    trace = t.contains("Traceback (most recent call last)") | t.contains("at Object.<anonymous>") | t.startswith('File "')
    return (
        F.when(F.length(t) < 15, "TOO_SHORT")
        .when(F.length(t) > 2500, "TOO_LONG")
        .when(t.startswith("|") | ((F.regexp_count(t, F.lit(r"\|")) >= 3) & t.contains("\n|")), "MARKDOWN_TABLE")
        .when(t.startswith("```") | (fences >= 2), "CODE_BLOCK")
        .when(trace, "STACK_TRACE")
        .when(t.contains("\x1b["), "ANSI_ESCAPE")
        .when(t.startswith("{") & t.endswith("}") & t.contains(":"), "RAW_JSON")
        .otherwise("CLEAN")
    )


def redact(text: Column) -> Column:
    """Secrets and home folders replaced by marks of their kind."""
    for pattern, mark in SECRET_PATTERNS + PATH_PATTERNS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def has_any(text: Column, words) -> Column:
    """Whether the lower-case text contains one of the words."""
    low = F.lower(text)
    found = F.lit(False)
    for word in words:
        found = found | low.contains(word)
    return found


def prohibited_terms(rule: Column) -> Column:
    """Terms that a rule forbids: words after each opening phrase, up to the clause's end."""
    low, stop = F.lower(rule), F.array(*map(F.lit, STOP_TERMS))

    def after(opening: str) -> Column:
        clause = F.regexp_extract(low, rf"(?s)^.*?{opening}(.*)$", 1)
        clause = F.regexp_replace(clause, r"(?s)([,.;]|always|instead).*$", "")
        words = F.split(clause, r"[^\p{L}\p{N}_]+")
        return F.filter(words, lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))

    return F.concat(*[after(p) for p in PROHIBITIONS])


def _bits(value: str) -> float:
    n = len(value)
    return 0.0 - sum(c / n * math.log2(c / n) for c in Counter(value).values())


@F.pandas_udf(T.DoubleType())
def _entropies(values: pd.Series) -> pd.Series:
    return values.map(_bits).astype("float64")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for null and empty texts."""
    return _entropies(F.coalesce(text, F.lit("")))


def token_entropy(text: Column) -> Column:
    """As ``entropy``, for short texts: an expression that lambdas can hold.

    Characters are sorted and folded in one pass, a run of equal ones at a time."""
    text = F.coalesce(text, F.lit(""))
    chars = F.sort_array(F.filter(F.split(text, ""), lambda c: c != ""))

    def after(s: Column) -> Column:
        """Bits with those of the run that ends."""
        return F.when(s["run"] > 0, s["bits"] - s["run"] / s["n"] * F.log2(s["run"] / s["n"])).otherwise(0.0)

    def step(s: Column, c: Column) -> Column:
        same = F.struct(s["char"].alias("char"), (s["run"] + 1).alias("run"), s["bits"].alias("bits"), s["n"].alias("n"))
        return F.when(s["char"] == c, same).otherwise(F.struct(c.alias("char"), F.lit(1.0).alias("run"), after(s).alias("bits"), s["n"].alias("n")))

    zero = F.struct(F.lit("").alias("char"), F.lit(0.0).alias("run"), F.lit(0.0).alias("bits"), F.length(text).cast("double").alias("n"))
    return F.aggregate(chars, zero, step, after)


def looks_secret(token: Column, least_bits: float = 4.5, least_length: int = 20) -> Column:
    return (F.length(token) >= least_length) & (token_entropy(token) >= least_bits)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")


def preview(text: Column, most: int = 120) -> Column:
    """One line of at most ``most`` characters, an ellipsis where it was cut."""
    line = collapse(text)
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…"))).otherwise(line)


def is_fix(subject: Column) -> Column:
    return subject.rlike(r"(?i)\b(fix|bug|patch|revert|hotfix|error|issue)\b")


def matches_glob(path: Column, pattern: Column) -> Column:
    """Whether a rule applies to a path: equal, below 'x/**', directly or deeper below 'x/*',
    or a path that ends in the pattern at a slash."""
    prefix = F.regexp_replace(pattern, r"\*+$", "")
    wild = pattern.rlike(r"/\*{1,2}$")
    return F.when(pattern == "**", True).when(wild, path.startswith(prefix)).otherwise((path == pattern) | path.endswith(F.concat(F.lit("/"), pattern)))
