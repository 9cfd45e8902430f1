"""Column expressions over message texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers that the log format writes into message texts.
SYSTEM_PHRASES = ("Continue from where you left off.", "Tool loaded.", "No response requested.")
TASK_NOTIFICATION = "<task-notification>"
CONTINUED = "This session is being continued"
INTERRUPTED = "[Request interrupted"
SKILL_BASE = "Base directory for this skill:"
SUMMARY_PREFIX = "This session is being continued from a previous conversation that ran out of context."
COMMAND_TAGS = ("local-command-stdout", "local-command-caveat", "user-prompt-submit-hook", "command-name")
REMINDER = r"(?s)<system-reminder>.*?</system-reminder>\s*"
DEFERRED_TOOLS = r"(?s)<available-deferred-tools>.*?</available-deferred-tools>\s*"
IMAGE_PATH = r"\[Image: source: ([^\]]+)\]"
ONLY_IMAGE_PATHS = r"^\[Image: source: [^\]]+\](\s*\[Image: source: [^\]]+\])*\s*$"
# Fixed value: the white space that the log format's own tools trim.
SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
INSTRUCTION_DOC = r"(?s)Contents of[^\n]*?CLAUDE\.md[^\n]*?:\n(.*?)(?:\n\nContents of|\n</|$)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_c(x), rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def present(x: Column | str) -> Column:
    """Null where empty: an empty string counts as absent."""
    return F.nullif(_c(x), F.lit(""))


def is_system_text(x: Column | str) -> Column:
    """Blank, a task notification, a continuation, only image paths, or a fixed phrase."""
    t = strip(x)
    return (t == "") | t.startswith(TASK_NOTIFICATION) | t.startswith(CONTINUED) | t.rlike(ONLY_IMAGE_PATHS) | t.isin(*SYSTEM_PHRASES)


def message_subtype(kind: Column | str, text: Column | str, stored: Column | str) -> Column:
    """C4: in order of precedence, for user rows; else the stored subtype."""
    t = F.regexp_replace(_c(text), r"^\s+", "")
    command = t.rlike("^<(?:" + "|".join(COMMAND_TAGS) + ")>")
    reminder = t.startswith("<system-reminder>") & (strip(F.regexp_replace(t, REMINDER, "")) == "")
    user = _c(kind) == "user"
    return (
        F.when(user & t.startswith(TASK_NOTIFICATION), "task-notification")
        .when(user & t.startswith(SKILL_BASE), "skill-output")
        .when(user & command, "command-output")
        .when(user & reminder, "system-reminder")
        .otherwise(_c(stored))
    )


def clean_user_text(x: Column | str) -> Column:
    """Without reminder and deferred-tool blocks."""
    return strip(F.regexp_replace(F.regexp_replace(_c(x), REMINDER, ""), DEFERRED_TOOLS, ""))


def image_paths(x: Column | str) -> Column:
    """Trimmed paths, in order."""
    return F.transform(F.regexp_extract_all(_c(x), F.lit(IMAGE_PATH), F.lit(1)), strip)


def command_output(x: Column | str) -> tuple[Column, Column]:
    """(label, output) of a command message."""
    t = _c(x)
    name = F.regexp_extract(t, r"<command-name>([^\n]*?)</command-name>", 1)
    part = lambda tag: strip(F.regexp_extract(t, rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    out = F.coalesce(present(part("local-command-stdout")), part("user-prompt-submit-hook"))
    label = F.when(name != "", name).when(out != "", "Terminal").otherwise("System")
    return label, F.when(label == "System", strip(F.regexp_replace(t, "<[^>]+>", ""))).otherwise(out)


def is_meaningful_first(x: Column | str) -> Column:
    t = strip(x)
    return (t != "") & ~t.startswith(INTERRUPTED) & ~t.startswith(CONTINUED)


def slug(x: Column | str) -> Column:
    """F8: at most 60 characters; ``heading`` if nothing is left."""
    t = F.regexp_replace(F.lower(_c(x)), "[^a-z0-9一-鿿_-]", "-")
    return F.coalesce(present(F.left(F.regexp_replace(F.regexp_replace(t, "-+", "-"), "^-|-$", ""), F.lit(60))), F.lit("heading"))


def safe_name(x: Column | str) -> Column:
    """M9: a file name without reserved and control characters."""
    t = F.regexp_replace(F.regexp_replace(_c(x), r'[<>:"/\\|?*\x00-\x1f]', ""), r"\s+", " ")
    return F.coalesce(present(F.left(strip(t), F.lit(60))), F.lit("untitled"))


def once(value: Column, body) -> Column:
    """``body`` of a value that is computed a single time, however often the body names it (in lambdas, once for each element otherwise)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(x: Column | str) -> Column:
    """Lines of a text, each with whether it is code: a line of a fence or between two. Takes time in proportion to the text."""

    def marked(parts: Column) -> Column:
        # the text before the first fence, then from each fence to the next: every second part is code
        last = F.size(parts) - 1
        rows = lambda p, i: F.split(F.when(i < last, F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p), "\n")
        every = F.flatten(F.transform(parts, lambda p, i: F.transform(rows(p, i), lambda y: F.struct(y.alias("line"), ((i % 2 == 1) | y.startswith("```")).alias("in_code")))))
        return once(every, lambda e: F.slice(e, F.lit(2), F.size(e) - 1))  # the first line is the one put before the text

    return once(F.split(F.concat(F.lit("\n"), _c(x)), r"(?dm)^(?=```)"), marked)


def bold_headings(x: Column | str) -> Column:
    """headings outside code as bold text, their own ``**`` taken out."""
    heading = rf"^#{{1,6}}[{SPACE}]+([^\n\r\u2028\u2029]+)\z"
    bold = lambda y: F.concat(F.lit("**"), F.regexp_replace(F.regexp_extract(y, heading, 1), r"\*\*", ""), F.lit("**"))
    return F.array_join(F.transform(lines(x), lambda y: F.when(~y["in_code"] & y["line"].rlike(heading), bold(y["line"])).otherwise(y["line"])), "\n")


def short_time(ts: Column | str) -> Column:
    """month/day and time, UTC."""
    return F.date_format(F.to_timestamp(_c(ts)), "M/d HH:mm")


def tool_preview(name: Column | str, arg) -> Column:
    """B12, viewer: the most telling argument. arg(field): that field of the input as a string."""
    n = _c(name)
    has = lambda names, field: n.isin(*names) & (F.coalesce(arg(field), F.lit("")) != "")
    return (
        F.when(has(["Bash"], "command"), F.left(arg("command"), F.lit(120)))
        .when(has(["Read", "Write", "Edit"], "file_path"), arg("file_path"))
        .when(has(["Grep", "Glob"], "pattern"), arg("pattern"))
        .when(has(["Skill"], "skill"), arg("skill"))
        .when(has(["Agent"], "prompt"), F.left(arg("prompt"), F.lit(80)))
        .otherwise("")
    )


def tool_line(name: Column | str, arg) -> Column:
    """B12, transcript: always ``[Name]``, with a first line of a command, a path, pattern or prompt."""
    n = _c(name)
    has = lambda names, field: n.isin(*names) & (F.coalesce(arg(field), F.lit("")) != "")
    what = (
        F.when(has(["Bash"], "command"), F.left(F.split_part(arg("command"), F.lit("\n"), F.lit(1)), F.lit(120)))
        .when(has(["Read", "Write", "Edit"], "file_path"), arg("file_path"))
        .when(has(["Grep"], "pattern"), arg("pattern"))
        .when(has(["Agent"], "prompt"), F.left(arg("prompt"), F.lit(80)))
    )
    return F.concat(F.lit("["), n, F.lit("]"), F.coalesce(F.concat(F.lit(" "), what), F.lit("")))
