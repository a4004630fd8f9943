"""Column functions over problem statements, patches, commands and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != ""))


#: What counts as a link, a commit, a picture or film, and a closing keyword.
LINK = r"https?://(?:www\.)?\S+"
COMMITS = r"(?<!/)\b[0-9a-f]{40}\b|\[[0-9a-f]{23}\]"
MEDIA = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".svg", ".webp", ".ico", ".heif", ".bpg", ".avif", ".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm", ".mpeg")
CLOSING = ("close", "closes", "closed", "fix", "fixes", "fixed", "resolve", "resolves", "resolved")


def _holds(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def has_link(c: Column, own_repo: str | None = None) -> Column:
    """A hyperlink; with a repository's name also one without a scheme, and none that repeats http://github.com/ and that name after its scheme."""
    if not own_repo:
        return _holds(c, LINK)
    skip = rf"(?!\Qhttp://github.com/{own_repo}\E)"
    return _holds(c, rf"https?://{skip}.+|www\.{skip}.+")


def has_commit_hash(c: Column) -> Column:
    """40 hexadecimal digits that aren't part of an address, or 23 in brackets."""
    return _holds(c, COMMITS)


def has_image(c: Column) -> Column:
    """A word with the ending of a picture or film."""
    return _holds(c, r"(?i)\b(" + "|".join(x.replace(".", r"\.") for x in MEDIA) + r")\b")


def issue_references(c: Column) -> Column:
    """Numbers after a closing keyword, with HTML comments taken out first."""
    return F.regexp_extract_all(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<!--.*?-->", ""), F.lit(rf"(?i)(?<!\w)(?:{'|'.join(CLOSING)})\s+#(\d+)"), F.lit(1))


def has_issue_reference(c: Column) -> Column:
    """A closing keyword before a number, or a GitLab issue list. Whether a bare number is an issue would take the network, and isn't looked up."""
    return _holds(c, rf"(?i)(?<!\w)(?:{'|'.join(CLOSING)})\s+#\d+") | _holds(c, r"https?://gitlab.com/(.*)/issues")


def issue_url(c: Column) -> Column:
    """owner, repo, number of an issue's address; null if it isn't one."""
    p = r"github\.com/([^/\s]+)/([^/\s]+)/(?:issues|pull)/(\d+)"
    return F.when(c.rlike(p), F.struct(F.regexp_extract(c, p, 1).alias("owner"), F.regexp_extract(c, p, 2).alias("repo"), F.regexp_extract(c, p, 3).cast("long").alias("number")))


def asserts_on_message(test_patch: Column) -> Column:
    """Tests that look at an exception's or warning's text: pytest's with a match argument, Django's in any case."""
    has = lambda *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(test_patch, w))
    return F.coalesce(F.when(has("pytest.raises", "pytest.warns", "pytest.deprecated_call"), F.contains(test_patch, F.lit("match"))).otherwise(has("assertOutput", "assertRaises", "checks.Error")), F.lit(False))


def has_attribute_or_import_error(log: Column) -> Column:
    """A line that tells of an attribute or an import and of an error or a failure."""
    return F.coalesce(F.exists(F.split(F.lower(log), "\n"), lambda x: x.rlike("attribute|import") & x.rlike("error|fail")), F.lit(False))


def patch_files(c: Column) -> Column:
    """Paths of a unified diff, from its headers, without /dev/null."""
    a = F.regexp_extract_all(c, F.lit(r"(?m)^diff --git a/\S+ b/(\S+)"), F.lit(1))
    b = F.regexp_extract_all(c, F.lit(r"(?m)^\+\+\+ (?:b/)?(\S+)"), F.lit(1))
    return F.filter(F.array_distinct(F.concat(a, b)), lambda x: x != "/dev/null")


def diff_summary(c: Column) -> Column:
    """files, lines_added, lines_removed, hunks."""
    lines = F.split(c, "\n")
    n = lambda p, head: F.size(F.filter(lines, lambda x: x.startswith(p) & ~x.startswith(head)))
    return F.struct(F.size(patch_files(c)).alias("files"), n("+", "+++").alias("lines_added"), n("-", "---").alias("lines_removed"), F.size(F.filter(lines, lambda x: x.startswith("@@"))).alias("hunks"))


def without_binary(c: Column) -> Column:
    """A diff without the file sections that hold binary changes."""
    return F.array_join(F.filter(F.split(c, r"(?m)(?=^diff --git )"), lambda s: ~s.rlike(r"(?m)^(Binary files .* differ|GIT binary patch)")), "")


def adds_or_removes_files(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?m)^(new file mode|deleted file mode|--- /dev/null|\+\+\+ /dev/null)"), F.lit(False))


#: What a patch holds in place of a diff if the model's service failed.
ERROR_MARKERS = ("Too many tokens per day", "RateLimitError", "429 Too Many Requests", "BedrockException", "ThrottlingException", "ServiceUnavailable", "InternalServerError")


def patch_class(c: Column) -> Column:
    """ok, empty or error: markers of a failed service come first."""
    text = F.coalesce(c, F.lit(""))
    return F.when(F.exists(F.array(*[F.lit(m) for m in ERROR_MARKERS]), lambda m: F.contains(text, m)), "error").when(~text.rlike(r"\S"), "empty").otherwise("ok")


def patch_limits(c: Column) -> Column:
    """files (modified ones), hunks, lines (added or removed), other_files (whether files are added or removed)."""
    lines = F.split(c, "\n")
    n = lambda f: F.size(F.filter(lines, f))
    changed = n(lambda x: x.rlike(r"^\+(?!\+\+ )")) + n(lambda x: x.rlike(r"^-(?!-- )"))
    created = n(lambda x: x.startswith("--- /dev/null")) + n(lambda x: x.startswith("+++ /dev/null"))
    return F.struct((n(lambda x: x.startswith("--- ")) - created).alias("files"), n(lambda x: x.startswith("@@ ")).alias("hunks"), changed.alias("lines"), adds_or_removes_files(c).alias("other_files"))


def truncated(c: Column, limit: int, marker: str = "\n...[truncated]", room: int = 18) -> Column:
    """A text of more than limit characters is cut to limit - room, and a marker follows."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(max(0, limit - room))), F.lit(marker))).otherwise(c)


def head_tail(c: Column, budget: Column, head: float = 0.65) -> Column:
    """The beginning and the end of a text within a budget of characters."""
    a = F.floor(budget * head).cast("int")
    return F.when(F.length(c) > budget, F.concat(F.left(c, a), F.lit(" … "), F.right(c, (budget - a).cast("int")))).otherwise(c)


def stripped(c: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def issue_text(c: Column) -> Column:
    """The body of <issue> or <pr_description>, else the whole text."""
    body = stripped(F.regexp_extract(c, r"(?is)<(?:issue|pr_description)>(.*?)</(?:issue|pr_description)>", 1))
    return F.when(body != "", body).otherwise(stripped(c))


def shortened(c: Column, width: int, left: bool = False) -> Column:
    """Exactly `width` characters: cut with …, or filled up with spaces."""
    cut = F.concat(F.lit("…"), F.right(c, F.lit(width - 1))) if left else F.concat(F.left(c, F.lit(width - 1)), F.lit("…"))
    return F.rpad(F.when(F.length(c) > width, cut).otherwise(c), width, " ")


def normalized_path(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^[./]+", ""), r"^[ab]/", "")


def identifier(c: Column) -> Column:
    """An id in lower case, without the names that folders add to it; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "^instance_", ""), r"_(?:miniswe|opencode)(?:-sample)?$", ""), F.lit(""))


#: Words for a result that holds and for one that doesn't.
YES, NO = ("resolved", "passed", "pass", "success", "true"), ("unresolved", "failed", "fail", "failure", "false")


def tri_state(c: Column) -> Column:
    """true, false or null from booleans, the numbers 0 and 1, and words."""
    x = F.lower(F.trim(c.cast("string")))
    return F.when(x.isin(*YES, "1", "1.0"), True).when(x.isin(*NO, "0", "0.0"), False)


def split_id(c: Column) -> tuple[Column, Column]:
    """Instance and sample of a folder name, which the last _ separates; without one all is the instance."""
    return F.when(F.instr(c, "_") > 0, F.regexp_extract(c, r"(?s)^(.*)_([^_]*)$", 1)).otherwise(c), F.when(F.instr(c, "_") > 0, F.regexp_extract(c, r"(?s)^(.*)_([^_]*)$", 2)).otherwise("")


def event_ordinal(c: Column) -> Column:
    return F.coalesce(F.substring(c, 2, 12).try_cast("int"), F.lit(-1))


def minor_version(c: Column) -> Column:
    """major.minor of a version in source text, docstrings taken out; assignments first, then any version line."""
    bare = F.regexp_replace(c, "(?s)\"\"\".*?\"\"\"|\'\'\'.*?\'\'\'", "")
    first = [r"__version__\s*=\s*['\"]v?([\d.]+)", r"VERSION\s*=\s*['\"]v?([\d.]+)", r"(?i)version\s*[=:]\s*['\"]?v?([\d.]+)"]
    tuple_ = F.regexp_replace(F.regexp_extract(bare, r"VERSION\s*=\s*\((\d+,\s*\d+)", 1), r",\s*", ".")
    found = [F.nullif(F.regexp_extract(bare, p, 1), F.lit("")) for p in first]
    return F.substring_index(F.coalesce(*found[:2], F.nullif(tuple_, F.lit("")), found[2]), ".", 2)


def commands(c: Column) -> Column:
    """Fragments of a shell line."""
    return F.filter(F.transform(F.split(c, r"&&|\|\||;|\n"), lambda x: F.trim(x)), lambda x: x != "")


def shell_blocks(c: Column) -> Column:
    """The fenced shell blocks of a message, trimmed, each once."""
    blocks = F.regexp_extract_all(c, F.lit(r"(?si)```(?:bash|sh|shell)?\s*\n(.*?)```"), F.lit(1))
    return F.coalesce(F.array_distinct(F.filter(F.transform(blocks, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")), F.array().cast("array<string>"))


#: Which commands run tests, edit, search and read, in this order but for tests, which come last.
TEST_COMMAND = r"(?i)(?:^|\s)(?:python\s+-m\s+)?pytest\b|(?:^|\s)python\s+-m\s+unittest\b|(?:^|\s)(?:npm|pnpm|yarn)\s+(?:run\s+)?test\b|(?:^|\s)go\s+test\b|(?:^|\s)cargo\s+test\b|(?:^|\s)tox\b"
COMMAND_KINDS = {
    "edit": r"\b(?:apply_patch|patch)\b|\bsed\s+-i\b|\b(?:tee|cat)\b[^\n]*>",
    "search": r"(?:^|\s)(?:rg|grep|find|fd)\b",
    "read": r"(?:^|\s)(?:cat|sed|head|tail|less|more|bat)\b",
    "test": TEST_COMMAND,
}
#: What a test run's output says, the first that fits.
OUTCOMES = {
    "failed": r"(?i)\b(?:FAILED|FAILURES?)\b|\b[1-9]\d* failed\b|AssertionError",
    "passed": r"(?i)\b(?:[1-9]\d*\s+)?passed\b|\bPASS(?:ED)?\b|\btests?\s+ok\b",
    "error": r"(?i)\bERRORS?\b|Traceback",
}


def _first(c: Column, table: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for name, pattern in reversed(table.items()):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def command_kind(c: Column) -> Column:
    """edit, search, read, test or other; the first that fits."""
    return _first(F.lower(F.trim(c)), COMMAND_KINDS, "other")


def runs_tests(c: Column) -> Column:
    """Whether a command runs tests, whatever else it does."""
    return _holds(c, TEST_COMMAND)


def test_outcome(c: Column) -> Column:
    return _first(c, OUTCOMES, "unknown")


_GIT = r"^git\s+(?:(?:-C|-c|--git-dir|--work-tree|--namespace)\s+\S+\s+|-\S+\s+)*([^-\s]\S*)"
_POINT = r"\b(?:head(?:[~^]\d*)?|[0-9a-f]{4,64})\b"
#: The class of each subcommand; or what makes it a reversion, and what it is else.
GIT_CLASSES = {"inspection": ("status", "diff", "log", "show", "branch", "blame", "rev-parse"), "recording": ("add", "commit"), "reversion": ("revert",), "destructive_cleanup": ("clean",)}
GIT_REVERSIONS = {"restore": (r"--worktree|^(?!.*--staged)", "index_change"), "reset": (r"--hard|" + _POINT, "index_change"), "checkout": (r"(?:^| )--(?: |$)|" + _POINT, "state_change")}


def git_commands(c: Column) -> Column:
    """The git invocations of a shell line."""
    found = F.transform(commands(c), lambda x: F.regexp_extract(x, r"\bgit\s+.+", 0))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def git_subcommand(c: Column) -> Column:
    """Global options are skipped, with their values; null if not git."""
    return F.when(c.rlike(r"^git\s"), F.coalesce(F.nullif(F.regexp_extract(F.trim(c), _GIT, 1), F.lit("")), F.lit("unknown")))


def git_class(c: Column) -> Column:
    """inspection, recording, reversion, index_change, destructive_cleanup or state_change; null if not git."""
    sub, out = git_subcommand(c), F.lit("state_change")
    for name, own in GIT_CLASSES.items():
        out = F.when(sub.isin(*own), name).otherwise(out)
    for name, (pattern, other) in GIT_REVERSIONS.items():
        out = F.when(sub == name, F.when(F.lower(c).rlike(pattern), "reversion").otherwise(other)).otherwise(out)
    return F.when(sub.isNotNull(), out)


#: What in a text names a file.
FILE_TOKEN = r"(?<![\w:/.-])(?:[A-Za-z0-9_.@+-]+/)+[A-Za-z0-9_.@+-]+|(?<![\w.-])[A-Za-z0-9_@+-]+\.(?:py|js|jsx|ts|tsx|go|rs|java|rb|php|cpp|c|h|hpp|md|yaml|yml|toml|json)(?![\w.-])"
NO_FILES = ("dev/null", "usr/bin/env")


def cleaned_path(c: Column) -> Column:
    """A path without quotes, brackets and a leading a/ or b/; null for addresses and for what is no file of the project."""
    x = F.regexp_replace(F.regexp_replace(c, "^['\"`()\\[\\]{}:,;<> ]+|['\"`()\\[\\]{}:,;<> ]+$", ""), r"^[ab]/", "")
    return F.when((x != "") & ~x.rlike("^https?://") & ~x.isin(*NO_FILES), x)


def file_tokens(c: Column) -> Column:
    """The files that a text names, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(c, F.lit(FILE_TOKEN), F.lit(0)), cleaned_path), lambda x: x.isNotNull()))


#: Where in shell commands paths stand, and the names of scratch files, which don't count.
TOUCHED = (
    r"((?:\./|/)[^\s|>;<\"'\\]+\.(?:py|txt|cfg|ini|toml|rst|md|c|h|js|ts|yaml|yml))",
    r"(?:cat|head|tail|nl|sed|grep|find|less|more|wc|diff)\s+[^|>;<]*?([a-zA-Z][\w/.-]*\.(?:py|txt|cfg|toml|rst|md|c|h))",
    r">\s*([a-zA-Z][\w/.-]*\.py)",
    r"sed\s+-i\s+[^|;]*?([a-zA-Z][\w/.-]*\.py)",
)
SCRATCH = r"^(test_|reproduce_|fix_|check_|debug_|verify_)"


def files_touched(content: Column) -> Column:
    """Paths in the fenced bash blocks of a message, without leading dots and slashes, without scratch files."""
    blocks = F.regexp_extract_all(content, F.lit(r"(?s)```bash\n(.*?)\n```"), F.lit(1))
    found = F.flatten(F.transform(blocks, lambda b: F.concat(*[F.regexp_extract_all(b, F.lit(p), F.lit(1)) for p in TOUCHED])))
    paths = F.transform(found, lambda x: F.regexp_replace(x, r"^[./]+", ""))
    return F.coalesce(F.array_distinct(F.filter(paths, lambda x: ~F.substring_index(x, "/", -1).rlike(SCRATCH))), F.array().cast("array<string>"))


#: Words that make a path one of tests.
TEST_WORDS = ("test", "tests", "testing")


def is_test_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), r"[ _/.]"), F.array(*[F.lit(w) for w in TEST_WORDS]))


def one_action(content: Column, fence: str = "bash") -> Column:
    """The command of a message that holds exactly one fenced block; null otherwise."""
    found = F.regexp_extract_all(content, F.lit(rf"(?s)```{fence}\s*\n(.*?)\n```"), F.lit(1))
    return F.when(F.size(found) == 1, stripped(found[0]))


def is_submission(output: Column, returncode: Column, sentinels: tuple[str, ...]) -> Column:
    """An output whose first line is a sentinel, of a command that succeeded."""
    first = stripped(F.substring_index(F.regexp_replace(output, r"^\s+", ""), "\n", 1))
    return F.coalesce(first.isin(*sentinels) & (F.coalesce(returncode, F.lit(0)) == 0), F.lit(False))


def over_limits(steps: Column, cost: Column, step_limit: Column, cost_limit: Column) -> Column:
    """Whether a run has reached a limit; a limit of 0 is none."""
    return F.coalesce(((step_limit > 0) & (steps >= step_limit)) | ((cost_limit > 0) & (cost >= cost_limit)), F.lit(False))


def image_name(instance_id: Column, prefix: str, suffix: str = ":latest") -> Column:
    """The image of an instance, in lower case; double underscores, which image names can't have, are written as _1776_."""
    return F.lower(F.concat(F.lit(prefix), F.replace(instance_id, F.lit("__"), F.lit("_1776_")), F.lit(suffix)))


def json_reply(c: Column) -> Column:
    """The JSON object in a model's reply: without a fence, from the first brace to the last; null if that doesn't parse."""
    body = F.regexp_extract(F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def keywords(c: Column) -> Column:
    """keywords and failed of a model's reply {"keywords": [...]}: trimmed, each once; failed tells a reply that isn't valid from an empty list."""
    parsed = F.from_json(json_reply(c), "keywords array<string>")["keywords"]
    own = F.array_distinct(F.filter(F.transform(parsed, stripped), lambda x: x != ""))
    return F.struct(F.coalesce(own, F.array().cast("array<string>")).alias("keywords"), parsed.isNull().alias("failed"))


def without_ansi(c: Column) -> Column:
    return F.regexp_replace(c, r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])", "")


def packed_labels(prompt: Column, answer: Column, mask: int = -100) -> Column:
    """Labels of a training row: the prompt's places masked, then the answer's ids."""
    return F.concat(F.array_repeat(F.lit(mask), F.size(prompt)), answer)


def greedy_packing(sizes: Column, budget: int) -> Column:
    """Of sizes in order, the numbers (from 0) of those that fit: one that doesn't is skipped, later ones may."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("take"))
    step = lambda s, x: F.struct((s["used"] + F.when(s["used"] + x <= budget, x).otherwise(0)).alias("used"), (s["i"] + 1).alias("i"), F.when(s["used"] + x <= budget, F.concat(s["take"], F.array(s["i"]))).otherwise(s["take"]).alias("take"))
    return F.aggregate(F.transform(sizes, lambda x: x.cast("long")), start, step, lambda s: s["take"])
