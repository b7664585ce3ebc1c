"""Session-step schema, label dimension and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# The 14 actions, alphabetical; the position is the class index.
LABELS = [
    "apply_patch",
    "ask_user",
    "edit_file",
    "glob_pattern",
    "grep_search",
    "lint_or_typecheck",
    "list_directory",
    "plan_task",
    "read_file",
    "respond_only",
    "run_bash",
    "run_tests",
    "web_search",
    "write_file",
]

# Semantic groups of the actions.
GROUPS = {
    "inspect": ["read_file", "grep_search", "glob_pattern", "list_directory"],
    "modify": ["edit_file", "apply_patch", "write_file"],
    "validate": ["run_tests", "lint_or_typecheck", "run_bash"],
    "reason": ["plan_task", "ask_user", "respond_only", "web_search"],
}
GROUP_OF = {label: group for group, labels in GROUPS.items() for label in labels}

# What each inspect action means, used when rows are paired with candidates.
INSPECT_MEANING = {
    "read_file": (
        "open a known file path and inspect that file's contents; "
        "a specific file is already identified; 지정된 파일 경로를 열어 내용을 읽기"
    ),
    "grep_search": (
        "search text, symbols, references, or usages inside file contents; "
        "파일 내용에서 문자열 심볼 참조 사용처 검색"
    ),
    "glob_pattern": (
        "find file paths by filename, extension, wildcard, or glob pattern; "
        "파일명 확장자 와일드카드 패턴으로 파일 경로 찾기"
    ),
    "list_directory": (
        "list immediate directory children or inspect folder and project structure; "
        "디렉터리 하위 항목과 폴더 구조 나열"
    ),
}

# Short action names of the compact trace view.
SHORT_NAME = {
    "apply_patch": "ap",
    "ask_user": "ask",
    "edit_file": "edit",
    "glob_pattern": "glob",
    "grep_search": "grep",
    "lint_or_typecheck": "lint",
    "list_directory": "ls",
    "plan_task": "plan",
    "read_file": "read",
    "respond_only": "resp",
    "run_bash": "bash",
    "run_tests": "test",
    "web_search": "web",
    "write_file": "write",
}

# Vocabularies of the two 93-wide feature layouts.
TIERS = ["free", "pro", "enterprise", "unknown"]
LANG_PREFS = ["en", "ko", "mixed", "unknown"]
CI_STATES = ["none", "passed", "failed", "unknown", "other"]
PRIMARY_LANGS = [
    "py", "js", "jsx", "ts", "tsx", "css", "html", "json", "yaml", "yml", "toml", "md",
    "go", "rs", "java", "kt", "cpp", "c", "sh", "sql", "vue", "dockerfile", "none", "other",
]
TRACE_LANG_PREFS = ["en", "ko", "unknown", "other"]
TRACE_CI_STATES = ["passed", "failed", "none", "unknown", "other"]
TRACE_PRIMARY_LANGS = [
    "py", "ts", "tsx", "js", "java", "kt", "rs", "go", "yaml", "sh", "md", "html",
    "css", "json", "sql", "vue", "toml", "dockerfile", "ipynb", "tf", "swift", "xml", "none", "other",
]

# Published class offsets (log-probability space) and decision settings.
CLASS_BIAS_SIM = [
    -0.4278571428571428, 0.05214285714285716, -0.04785714285714282, 0.14214285714285713,
    -0.04785714285714282, 0.3021428571428571, 0.3421428571428571, -0.04785714285714282,
    -0.04785714285714282, -0.04785714285714282, -0.19785714285714284, 0.05214285714285716,
    0.12214285714285716, -0.14785714285714285,
]
CLASS_BIAS_AU = [0.0] * 14
STACK = {
    "au_prefix": "sess_au",
    "sim_weights": (0.60, 0.40),
    "au_weights": (0.50, 0.50),
    "margin_lt": 0.08,
    "confidence_ge": 0.55,
}

# Metadata that does not change while a session runs.
STABLE_META = ["language_pref", "user_tier", "primary_language", "language_mix", "top_lang"]

EVENT = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("name", T.StringType()),
    # List-valued arguments keep their JSON text; insertion order of keys is kept.
    T.StructField("args", T.MapType(T.StringType(), T.StringType())),
    T.StructField("result_summary", T.StringType()),
])

WORKSPACE = T.StructType([
    T.StructField("open_files", T.ArrayType(T.StringType())),
    T.StructField("git_dirty", T.BooleanType()),
    T.StructField("last_ci_status", T.StringType()),
    T.StructField("language_mix", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("loc", T.DoubleType()),
])

SESSION_META = T.StructType([
    T.StructField("user_tier", T.StringType()),
    T.StructField("language_pref", T.StringType()),
    T.StructField("budget_tokens_remaining", T.DoubleType()),
    T.StructField("turn_index", T.DoubleType()),
    T.StructField("elapsed_session_sec", T.DoubleType()),
    T.StructField("workspace", WORKSPACE),
])

MINING_META = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("source_event_index", T.IntegerType()),
    T.StructField("source_event_signature", T.StringType()),
    T.StructField("dynamic_meta_preserved", T.BooleanType()),
])

SESSION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("current_prompt", T.StringType()),
    T.StructField("history", T.ArrayType(EVENT)),
    T.StructField("session_meta", SESSION_META),
])


def sql_literal(value) -> str:
    """SQL text of a literal: string, float, int or None."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"double({value!r})"
    return str(value)


def strings(values) -> Column:
    """A literal array of strings."""
    return F.expr(f"array({', '.join(sql_literal(v) for v in values)})")


def doubles(values) -> Column:
    """A literal array of doubles."""
    return F.expr(f"cast(array({', '.join(sql_literal(float(v)) for v in values)}) as array<double>)")


def literal_rows(names: list[str], rows) -> Column:
    """A literal array of structs: a small parameter table inside the plan."""
    cells = [
        "struct(" + ", ".join(f"{sql_literal(v)} as {n}" for n, v in zip(names, row)) + ")" for row in rows
    ]
    return F.expr(f"array({', '.join(cells)})")


def lookup(mapping: dict) -> Column:
    """A literal map column."""
    return F.expr(f"map({', '.join(sql_literal(x) for pair in mapping.items() for x in pair)})")
