"""Clones of program text: runs of normalised tokens, skeletons of blocks, and patterns of fragments."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.clones import LEAST, TILE, lsh_pairs, met_runs, runs_of_windows, signatures
from lodestone.operators.windows import common_runs, hashed
from lodestone.tables import written

# The words that stay as they are in normalised tokens.
KEYWORDS = (
    "abstract as any asserts async await boolean break case catch class const continue debugger declare default delete do else enum export extends false "
    "finally for from function get if implements import in instanceof interface is keyof let module namespace never new null number of package private "
    "protected public readonly record return require satisfies set static string super switch symbol this throw true try type typeof undefined unique "
    "unknown var void while with yield"
).split()
PYTHON_KEYWORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or "
    "pass raise return try while with yield"
).split()
#: Fixed values, in the order in which they are tried: comments, strings, numbers, names, operators, separators.
COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
PYTHON_ONLY = r"#[^\n]*|'''[\s\S]*?'''|\"\"\"[\s\S]*?\"\"\""
REST = r"'[^']*'|\"[^\"]*\"|`[^`]*`|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?n?|[A-Za-z_$][A-Za-z0-9_$]*|[+\-*/%=<>!&|^~?:]+|[{}\[\]();,.\n]"


def is_python(path: Column) -> Column:
    return F.lower(path).endswith(".py")


def raw_tokens(content: Column, python: Column) -> Column:
    """All tokens, comments and line ends among them; whatever is no token is passed over."""
    found = lambda p: F.regexp_extract_all(content, F.lit(f"({p})"), F.lit(1))
    return F.when(python, found(f"{COMMENT}|{PYTHON_ONLY}|{REST}")).otherwise(found(f"{COMMENT}|{REST}"))


def _is_comment(t: Column, python: Column) -> Column:
    block = t.startswith("/*") & t.endswith("*/") & (F.length(t) >= 4)
    return t.startswith("//") | block | (python & t.startswith("#"))


def norm(t: Column, python: Column) -> Column:
    """A keyword, operator's O, literal's L, name's I, or separator; null for comments and line ends."""
    first = F.substring(t, 1, 1)
    word = F.when(F.when(python, t.isin(PYTHON_KEYWORDS)).otherwise(t.isin(KEYWORDS)), t).otherwise("I")
    return (
        F.when((t == "\n") | _is_comment(t, python), None).when(first.rlike("['\"`0-9]"), "L")
        .when(first.rlike("[A-Za-z_$]"), word).when(first.rlike(r"[{}\[\]();,.]"), t).otherwise("O")
    )


def tokenised(corpus: DataFrame) -> DataFrame:
    """file, w: the normalised tokens of each file, which is named by repository and path."""
    own = corpus.where("content IS NOT NULL").select(file_name().alias("file"), is_python(F.col("path")).alias("python"), F.col("content"))
    # The tokens are a column first, as the lambda would look for them anew.
    own = own.select("file", "python", raw_tokens(F.col("content"), F.col("python")).alias("t"))
    norms = F.transform("t", lambda t: norm(t, F.col("python")))
    return own.select("file", F.filter(norms, lambda x: x.isNotNull()).alias("w"))


def file_name() -> Column:
    return F.concat_ws("/", F.coalesce("repository", F.lit("")), "path")


def token_lines(corpus: DataFrame) -> DataFrame:
    """file, pos (from 0), line: where each normalised token begins.  Line ends within tokens count."""
    own = corpus.where("content IS NOT NULL").select(file_name().alias("file"), is_python(F.col("path")).alias("python"), F.col("content"))
    own = own.select("file", "python", raw_tokens(F.col("content"), F.col("python")).alias("t"))
    ends = F.transform("t", lambda t: F.struct(norm(t, F.col("python")).isNotNull().alias("kept"), (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).alias("ends")))
    # Only tokens at the end of a line or over several add to the line, so runs of tokens on one line fold to one entry.
    begin = F.struct(F.lit(0).alias("pos"), F.lit(1).alias("line"), F.array().cast("array<struct<pos:int,line:int>>").alias("lines"))
    step = lambda s, x: F.struct(
        (s.pos + x.kept.cast("int")).alias("pos"), (s.line + x.ends).alias("line"),
        F.when((x.ends > 0), F.concat(s.lines, F.array(F.struct((s.pos + x.kept.cast("int")).alias("pos"), (s.line + x.ends).alias("line"))))).otherwise(s.lines).alias("lines"),
    )
    starts = F.aggregate(ends, begin, step, lambda s: s.lines)
    return own.select("file", F.concat(F.array(F.struct(F.lit(0).alias("pos"), F.lit(1).alias("line"))), starts).alias("lines"))


def _line_at(lines: Column, pos: Column) -> Column:
    """The line of a token: that of the last line that begins at or before it."""
    return F.element_at(F.filter(lines, lambda x: x.pos <= pos), -1)["line"].cast("long")


def clone_classes(corpus: DataFrame) -> DataFrame:
    """file, representative: files with equal normalised tokens have one that stands for them."""
    own = tokenised(corpus).select("file", F.sha2(F.to_json("w"), 256).alias("hash"))
    least = own.groupBy("hash").agg(F.min("file").alias("representative"))
    return own.join(least, "hash").select("file", "representative")


def code_clones(corpus: DataFrame, size: int = TILE) -> DataFrame:
    """file_a, file_b, start_a, end_a, start_b, end_b (lines), n_tokens: maximal runs of at least ``size``
    normalised tokens that two files have in common, between files that stand for their clone_classes;
    renamed names and other literals make no difference."""
    own = written(tokenised(corpus))
    first = own.groupBy(F.sha2(F.to_json("w"), 256).alias("h")).agg(F.min("file").alias("file"))
    distinct = own.join(first.select("file"), "file", "left_semi").select(F.col("file").alias("key"), "w")
    found = written(common_runs(distinct.select("key", F.xxhash64("key").alias("t"), hashed(F.col("w"))), size))
    lines = token_lines(corpus)
    for x in "ab":
        at = lines.select(F.col("file").alias(f"doc_{x}"), F.col("lines").alias(f"lines_{x}"))
        found = found.join(at, f"doc_{x}").withColumns({f"begin_{x}": _line_at(F.col(f"lines_{x}"), F.col(f"start_{x}")), f"end_{x}": _line_at(F.col(f"lines_{x}"), F.col(f"start_{x}") + F.col("n_tokens") - 1)})
    return found.select(F.col("doc_a").alias("file_a"), F.col("doc_b").alias("file_b"), F.col("begin_a").alias("start_a"), "end_a", F.col("begin_b").alias("start_b"), "end_b", "n_tokens")


def clone_findings(clones: DataFrame) -> DataFrame:
    """A finding for each side of each clone, longest first within a file."""
    sides = []
    for a, b in ("ab", "ba"):
        message = F.concat(F.lit("Clone of "), F.col(f"file_{b}"), F.lit(":"), F.col(f"start_{b}"), F.lit("-"), F.col(f"end_{b}"), F.lit(" ("), F.col("n_tokens"), F.lit(" tokens)"))
        sides.append(clones.select(F.lit("cpd-clones").alias("pattern_id"), F.col(f"file_{a}").alias("file_path"), F.col(f"start_{a}").alias("line"), F.col(f"end_{a}").alias("end_line"), message.alias("message"), F.lit("warning").alias("severity"), F.lit("duplication").alias("category"), "n_tokens"))
    return sides[0].unionByName(sides[1])


# Skeletons of blocks ----------------------------------------------------------------------------------

# The kinds of blocks, how each begins and ends, and its name.
BLOCKS = (
    ("lambda", r"(?:const|let|var)\s+(?P<label>\w+)\s*=\s*(?:\([^)]*\)\s*=>\s*\{[\s\S]*?\n\})"),
    ("function", r"function\s+(?P<label>\w+)\s*\([^)]*\)\s*\{[\s\S]*?\n\}"),
    ("function", r"async\s+function\s+(?P<label>\w+)\s*\([^)]*\)\s*\{[\s\S]*?\n\}"),
    ("method", r"(?m:^)\s+(?:async\s+)?(?P<label>\w+)\s*\([^)]*\)\s*\{[\s\S]*?\n\s+\}"),
    ("class", r"class\s+(?P<label>\w+)\s*(?:extends\s+\w+\s*)?\{[\s\S]*?\n\}"),
    ("class", r"class\s+(?P<label>\w+)\s+implements\s+\w+(?:\s*,\s*\w+)*\s*\{[\s\S]*?\n\}"),
)
CALL_KEYWORDS = frozenset("if else for while do switch case catch return throw typeof instanceof delete void new function class async await yield".split())
SKELETON_KEYWORDS = frozenset(
    "if else for while do switch case break continue return throw try catch finally typeof instanceof delete void new this function class extends implements "
    "interface const let var import export from default async await yield of in as is satisfies true false null undefined NaN Infinity".split()
)
#: A skeleton that says something has so many lines and characters.
LINES, CHARACTERS = 3, 50


def _names(but: frozenset[str], end: str = "") -> str:
    return rf"(?<![\w'\"`])(?!(?:{'|'.join(sorted(but))})\b)[A-Za-z_]\w*{end}"


#: Classes of tokens, the first that fits holds, with what stands for each; None leaves it as it is.
TOKEN_CLASSES = (
    ("type", r":\s*\w+(?:<[^>]+>)?(?:\[\])?", ":$TYPE"),
    ("literal", r"['\"][^'\"]*['\"]|`[^`]*`", "$LIT"),
    ("number", r"\b[0-9]+(?:\.[0-9]+)?[nL]?\b", "$NUM"),
    ("call", _names(CALL_KEYWORDS, r"\s*\("), "$FN("),
    ("dollar", r"\$\w+(?![\w]|\s*\()", None),
    ("name", _names(SKELETON_KEYWORDS, r"\b"), "$ID"),
    ("word", r"\w+", None),
    ("indent", r"(?m:^)\s+", ""),
    ("gap", r"[ \t]+", " "),
)
_TOKEN = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern, _ in TOKEN_CLASSES), re.A)
_STANDS = {name: put for name, _, put in TOKEN_CLASSES}


def skeleton_of(text: str) -> str:
    """Types, strings, numbers, calls and other names as placeholders; keywords and signs stay.  One pass:
    each token is of one class, so nothing is looked for within what is already replaced."""

    def put(m: re.Match) -> str:
        stands = _STANDS[m.lastgroup]
        return m[0] if stands is None else stands

    return _TOKEN.sub(put, text).strip()


_BLOCKS = tuple((kind, re.compile(pattern, re.A)) for kind, pattern in BLOCKS)


def blocks_of(code: str) -> list[tuple[str, str, int, int, str]]:
    """(label, kind, first line, last line, text) of functions, methods and classes; kind and label are
    those of the rule that finds a block, whatever the block holds."""
    breaks = [m.start() for m in re.finditer("\n", code)]
    line = lambda at: bisect.bisect_left(breaks, at) + 1
    return [(m["label"], kind, line(m.start()), line(m.end()), m[0]) for kind, rule in _BLOCKS for m in rule.finditer(code)]


def meaningful(skeleton: Column) -> Column:
    rows = F.size(F.filter(F.split(skeleton, "\n"), lambda x: F.trim(x) != ""))
    return (rows >= LINES) & (F.length(skeleton) >= CHARACTERS)


def block_skeletons(corpus: DataFrame) -> DataFrame:
    """file, label, kind, start_line, end_line, skeleton: every block of every file."""

    def run(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            rows = [(f, a, k, s, e, skeleton_of(t)) for f, c in zip(batch["file"], batch["content"]) for a, k, s, e, t in blocks_of(c)]
            if rows:
                yield pd.DataFrame(rows, columns=["file", "label", "kind", "start_line", "end_line", "skeleton"])

    own = corpus.where("content IS NOT NULL").select(file_name().alias("file"), "content")
    return own.mapInPandas(run, "file string, label string, kind string, start_line long, end_line long, skeleton string")


def structural_clones(corpus: DataFrame, least: float = LEAST) -> DataFrame:
    """file_a, label_a, start_a, end_a, the same of b, similarity: blocks of different files whose
    skeletons' signatures agree in at least so many functions.  Equal skeletons meet once: signatures
    and pairs are of distinct skeletons, and the blocks of a pair are joined to it at the end."""
    found = written(block_skeletons(corpus).where(meaningful(F.col("skeleton"))))
    distinct = written(found.select("skeleton").distinct().withColumn("key", F.monotonically_increasing_id()))
    pairs = lsh_pairs(written(signatures(distinct, "key", "skeleton")), least)
    same = distinct.select(F.col("key").alias("doc_a"), F.col("key").alias("doc_b"), F.lit(1.0).alias("similarity"))
    pairs = written(pairs.unionByName(pairs.select(F.col("doc_b").alias("doc_a"), F.col("doc_a").alias("doc_b"), "similarity")).unionByName(same))
    blocks = written(found.join(distinct, "skeleton").drop("skeleton"))
    side = lambda x: blocks.select(F.col("key").alias(f"doc_{x}"), F.col("file").alias(f"file_{x}"), F.col("label").alias(f"label_{x}"), F.col("start_line").alias(f"start_{x}"), F.col("end_line").alias(f"end_{x}"))
    both = pairs.join(side("a"), "doc_a").join(side("b"), "doc_b").where("file_a < file_b")
    return both.select("file_a", "label_a", "start_a", "end_a", "file_b", "label_b", "start_b", "end_b", "similarity")


# Fragments --------------------------------------------------------------------------------------------

# The names that stay as they are in a fragment's pattern.
PATTERN_KEYWORDS = frozenset(
    "function const let var class interface type enum if else for while do switch case break continue return throw try catch finally new delete typeof "
    "instanceof void in of import export from default async await yield this super true false null undefined number string boolean any never unknown "
    "public private protected static readonly abstract extends implements as satisfies keyof and or not is def lambda console process Math JSON Promise "
    "Array Object String Number Boolean Error Date RegExp Map Set Symbol Buffer".split()
)


def fragment_pattern(fragment: str) -> str:
    """Names as $ID_0, $ID_1 and so on, one for each name; numbers as $NUM_0 and so on, one for each place."""
    names: dict[str, str] = {}
    numbers = iter(range(len(fragment) + 1))
    out = re.sub(r"\b[A-Za-z_$][A-Za-z0-9_$]*\b", lambda m: m[0] if m[0] in PATTERN_KEYWORDS else names.setdefault(m[0], f"$ID_{len(names)}"), fragment, flags=re.A)
    return re.sub(r"\b[0-9]+(\.[0-9]+)?\b", lambda m: f"$NUM_{next(numbers)}", out, flags=re.A)


def fragment_patterns(fragments: DataFrame, text: str, name: str = "pattern") -> DataFrame:
    """fragments with the pattern of each."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fragment_pattern(t))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return fragments.withColumn(name, F.pandas_udf(run, "string")(F.col(text)))


def find_fragments(fragments: DataFrame, key: str, text: str, corpus: DataFrame, size: int = 8) -> DataFrame:
    """key, file, start_line, end_line, n_tokens: where files hold at least ``size`` tokens of a fragment
    in a row, whatever their names and literals; every fragment in one pass over the corpus."""
    own = fragments.select(F.lit("").alias("repository"), F.col(key).cast("string").alias("path"), F.col(text).alias("content"))
    mine = runs_of_windows(tokenised(own).select(F.substring_index("file", "/", -1).alias("key"), "w"), size)
    theirs = runs_of_windows(tokenised(corpus).select(F.col("file").alias("key"), "w"), size)
    met = mine.select(F.col("key").alias("doc_a"), F.col("pos").alias("pos_a"), "h1", "h2").join(theirs.select(F.col("key").alias("doc_b"), F.col("pos").alias("pos_b"), "h1", "h2"), ["h1", "h2"])
    found = written(met_runs(met, size))
    lines = token_lines(corpus).select(F.col("file").alias("doc_b"), "lines")
    found = found.join(lines, "doc_b")
    return found.select(F.col("doc_a").alias(key), F.col("doc_b").alias("file"), _line_at(F.col("lines"), F.col("start_b")).alias("start_line"), _line_at(F.col("lines"), F.col("start_b") + F.col("n_tokens") - 1).alias("end_line"), "n_tokens")
