"""Text functions on columns. All run in the JVM; ANSI mode is assumed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
LANGUAGE_ALIASES = {"js": "javascript", "ts": "typescript", "c++": "cpp", "c#": "csharp", "cs": "csharp"}
FENCE_TAGS = {
    "python": ["python", "py"],
    "java": ["java"],
    "javascript": ["javascript", "js", "typescript", "ts", "jsx", "tsx"],
    "cpp": ["cpp", "c++", "cc", "cxx"],
    "csharp": ["csharp", "cs", "c#"],
}
CODE_STARTS = {
    "python": ["def ", "class ", "import ", "from "],
    "java": ["package ", "import ", "public class ", "class "],
    "javascript": ["function ", "const ", "let ", "var ", "class "],
    "cpp": ["#include", "using namespace", "int main", "class "],
    "csharp": ["using ", "namespace ", "public class ", "class "],
}
SNIPPET_MARKS = ["function ", "class ", "=>", "def ", "public ", "private ", "protected ", "#include"]
LINE_ENDS = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"
TRIMMED = "\n...[trimmed]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f of value, which is computed once even where f uses it in a lambda: Spark would put its expression there."""
    return F.get(F.transform(F.array(value), f), 0)


def lines(c: Column | str) -> Column:
    """Lines without their ends; a final end adds no empty line, and an empty text has no line."""
    return let(F.split(col(c), LINE_ENDS, -1), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def tokens(c: Column | str) -> Column:
    """Lower-case words between white space of any script."""
    return F.filter(F.split(F.lower(col(c)), "(?U)[\\s\\x1c-\\x1f]+"), lambda w: w != "")


def eval_tokens(c: Column | str) -> Column:
    """Lower-case words, and single marks between them."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit("(?U)(\\w+|[^\\w\\s])"), F.lit(1))


def normalized(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), "\\s+", " "))


def non_ascii_ratio(c: Column | str) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(text, "[\\x00-\\x7F]", "")), F.length(text)), F.lit(0.0))


def encoding_blob(*cols: str) -> Column:
    """Texts joined by newlines, for the encoding filter; nulls count as empty."""
    return F.concat_ws("\n", *[F.coalesce(col(c), F.lit("")) for c in cols])


def fingerprint(*cols: str) -> Column:
    """SHA-1 of the fields joined by bars; null and missing fields are empty."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in cols]))


def repo_key(repo: Column | str, *fallback: Column | str) -> Column:
    """The repository's name, or a stable stand-in where it is blank or unknown."""
    name = F.trim(F.coalesce(col(repo), F.lit("")))
    basis = F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in fallback])
    return F.when((name != "") & (F.lower(name) != "unknown"), name).otherwise(F.concat(F.lit("pseudo-"), F.substring(F.sha1(basis), 1, 12)))


def alias_language(c: Column | str) -> Column:
    v = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, v), v)


def first_present(columns: list[str], available: list[str], default: str = "") -> Column:
    """The first column of those there are whose value isn't null, as a string."""
    return F.coalesce(*[F.col(c).cast("string") for c in columns if c in available], F.lit(default))


def padded_tokens(c: Column | str, size: int) -> Column:
    """tokens; short texts are padded by underscores to size."""
    return let(tokens(c), lambda w: F.concat(w, F.array_repeat(F.lit("_"), F.greatest(F.lit(0), size - F.size(w)))))


def shingles(c: Column | str, size: int = 5) -> Column:
    """Distinct runs of size tokens; short texts are padded by underscores."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
    return F.array_distinct(let(padded_tokens(c, size), runs))


def trimmed(c: Column | str, n: Column | int, mark: str = TRIMMED) -> Column:
    """At most n characters, then the mark; white space before it goes."""
    text, n = col(c), n if isinstance(n, Column) else F.lit(n)
    return F.when(F.length(text) > n, F.concat(F.regexp_replace(F.substring(text, F.lit(1), n), "\\s+$", ""), F.lit(mark))).otherwise(text)


def preview(c: Column | str, n: int) -> Column:
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit("..."))).otherwise(col(c))


def task_prefixed(text: Column | str, objective: Column | str) -> Column:
    text, tag = F.coalesce(col(text), F.lit("")), F.concat(F.lit("[TASK: "), col(objective), F.lit("]"))
    return F.when(text.startswith(tag), text).when(text == "", tag).otherwise(F.concat(tag, F.lit("\n"), text))


def prompt(instruction: Column | str, code: Column | str, answer: Column | str) -> Column:
    """The training prompt: headed sections, the answer last."""
    return F.concat(F.lit("### Task\n"), col(instruction), F.lit("\n\n### Input\n"), col(code), F.lit("\n\n### Response\n"), col(answer))


def token_estimate(c: Column | str, chars: float = 3.5) -> Column:
    n = F.length(F.coalesce(col(c), F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / chars))).cast("long")


def token_budget(used: Column | str, window: int, margin: float = 0.15) -> Column:
    return F.greatest(F.lit(256), F.lit(window) - col(used) - int(window * margin)).cast("long")


def human_bytes(c: Column | str) -> Column:
    size = col(c).cast("double")
    out = F.lit(None).cast("string")
    for k, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        value = F.format_string("%.2f " + unit, F.bround(size / 1024.0**k, 2))
        out = value if unit == "TB" else F.when(size < 1024.0 ** (k + 1), value).otherwise(out)
    return out


def looks_like_snippet(c: Column | str) -> Column:
    low = F.lower(F.coalesce(col(c), F.lit("")))
    found = F.lit(False)
    for mark in SNIPPET_MARKS:
        found |= low.contains(mark)
    return found


def heuristic_valid(language: Column | str, code: Column | str) -> Column:
    """The light syntax rules: eight characters, and a keyword of the language."""
    lang, text = col(language), F.coalesce(col(code), F.lit(""))
    has = lambda *words: F.greatest(*[text.contains(w) for w in words], F.lit(False))
    rule = (
        F.when(lang == "python", has("def ", "class "))
        .when(lang == "java", has("class ", "public "))
        .when(lang == "javascript", has("function", "=>"))
        .when(lang == "cpp", has("{"))
        .when(lang == "csharp", has("class ", "namespace "))
        .otherwise(True)
    )
    return (F.length(text) >= 8) & rule


def code_span(text: Column | str, language: str) -> Column:
    """The fenced block of the language, or the first block; without any, the text from the first sign of code on."""
    text = F.coalesce(col(text), F.lit(""))
    fence = F.lit("(?s)```([A-Za-z0-9_+#-]*)\\n(.*?)```")
    tags, bodies = F.regexp_extract_all(text, fence, F.lit(1)), F.regexp_extract_all(text, fence, F.lit(2))
    wanted = F.array(*[F.lit(t) for t in FENCE_TAGS.get(language, [language])])
    own = F.filter(F.arrays_zip(tags.alias("t"), bodies.alias("b")), lambda x: F.array_contains(wanted, F.lower(x["t"])))
    starts = F.array_min(F.filter(F.array(*[F.instr(text, m) for m in CODE_STARTS.get(language, ["class "])]), lambda i: i > 0))
    rest = F.when(starts.isNull(), text).otherwise(F.substring(text, starts, F.length(text)))
    return F.when(F.size(bodies) > 0, F.coalesce(F.get(own, 0)["b"], F.get(bodies, 0))).otherwise(rest)


def without_overlap(before: Column | str, after: Column | str) -> Column:
    """after without its longest start that before ends with."""
    a, b = col(before), col(after)
    longest = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda n: (n == 0) | (F.right(a, n) == F.left(b, n))))
    return F.substring(b, longest + 1, F.length(b))


def ngrams(words: Column, n: int) -> Column:
    def runs(w):
        count = F.size(w) - n + 1
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), "\x01"))).otherwise(F.array().cast("array<string>"))

    return let(words, runs)
