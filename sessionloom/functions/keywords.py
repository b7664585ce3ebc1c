"""Keyword flags and tokens. Word lists are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sessionloom.functions.base import let
from sessionloom.functions.buckets import band_float, bin_floor
from sessionloom.functions.events import action_names, find_all, items, nth_last, open_files
from sessionloom.functions.text import compact, flag, has_any

# Keyword groups of the engineered text view.
KEYWORD_GROUPS = {
    "KW_READ_FILE": ["read file", "open file", "view file", "show file", "inspect file", "cat ", "print file",
                     "check file contents", "파일", "열어", "읽", "보여", "확인", "내용 확인"],
    "KW_GREP_SEARCH": ["grep", "search for", "find occurrences", "find references", "look for", "where is", "keyword",
                       "symbol", "검색", "찾", "찾기", "참조", "위치"],
    "KW_GLOB_PATTERN": ["glob", "pattern", "*.py", "*.json", "*.csv", "*.txt", "*.md", "**/", "matching files",
                        "file extension", "패턴", "확장자", "파일들"],
    "KW_LIST_DIRECTORY": ["list directory", "list files", "show files", "directory contents", "folder contents", "ls ",
                          "tree", "what files", "목록", "디렉토리", "폴더", "파일 목록", "구조"],
    "KW_RUN_TESTS": ["pytest", "unittest", "unit test", "run tests", "test suite", "npm test", "yarn test", "cargo test",
                     "go test", "make test", "happy path", "profile tests", "테스트", "실험"],
    "KW_LINT_TYPECHECK": ["lint", "typecheck", "type check", "type-check", "mypy", "ruff", "flake8", "eslint", "tsc",
                          "pyright", "prettier", "린트", "타입체크", "타입 체크", "정적 검사"],
    "KW_RUN_BASH": ["bash", "shell", "terminal", "command", "execute", "run command", "install", "chmod",
                    "python script", "docker", "명령", "실행", "터미널", "설치"],
    "KW_ASK_USER": ["clarify", "ask user", "confirm", "ambiguous", "need more information", "which one", "should i",
                    "확인", "물어", "모호", "어느", "선택"],
    "KW_PLAN_TASK": ["plan", "steps", "approach", "break down", "todo", "strategy", "outline", "계획", "단계", "전략",
                     "정리"],
    "KW_WEB_SEARCH": ["web", "internet", "online", "browse", "latest", "up to date", "recent", "search online", "웹",
                      "인터넷", "최신", "최근", "검색해", "찾아봐"],
    "KW_APPLY_PATCH": ["patch", "diff", "apply patch", "fix bug", "change code", "패치", "수정", "고쳐", "버그"],
    "KW_EDIT_FILE": ["edit file", "rewrite", "replace", "update file", "modify file", "파일 수정", "수정해", "바꿔",
                     "교체", "업데이트"],
    "KW_WRITE_FILE": ["create file", "write file", "new file", "save as", "파일 생성", "새 파일", "작성", "저장"],
}

# Needles of the inspect intents.
INTENTS = {
    "read": ["open", "read", "show me", "pull up", "cat ", "view", "look at", "열어", "읽", "보여", "봐"],
    "search": ["where", "where else", "find", "search", "grep", "reference", "references", "usage", "usages",
               "occurrence", "occurrences", "who calls", "called from", "defined", "어디", "어디서", "찾", "검색",
               "호출", "참조", "정의", "쓰"],
    "list": ["list", "ls ", "tree", "directory", "folder", "what files", "which files", "contents of", "목록", "폴더",
             "디렉토리", "뭐뭐", "구조"],
    "glob": ["glob", "pattern", "matching files", "all files", "every file", "recursive", "recursively", "extension",
             "패턴", "확장자", "전부", "재귀"],
}
DEICTIC = ["it", "that", "that file", "the file", "the one", "this one", "one of", "그거", "이거", "그 파일", "이 파일"]

# A word boundary over Unicode letters and digits.
_EDGE = r"(?:(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_]))"
# Fixed value: what counts as a path in a prompt.
PATH_HINT = (
    r"(?i)(?:[A-Za-z]:[\\/]|[./\\][\p{L}\p{N}_./\\-]+|"
    + _EDGE
    + r"[\p{L}\p{N}_./\\-]+\.(?:py|js|ts|tsx|json|csv|md|txt|yaml|yml|ipynb|go|rs|java|kt|css|scss|html|toml|ini|cfg|lock)(?![\p{L}\p{N}_]))"
)

# Hint flags; each list is searched in the text named by the first item
# (all: prompt and context, prompt: prompt and last user message, context: the rest).
HINTS = {
    "ih": ("all", ["read", "open", "show", "grep", "search", "find", "glob", "pattern", "list", "directory", "folder",
                   "file", "열어", "읽어", "보여", "찾아", "검색", "호출", "참조", "목록", "디렉토리", "폴더", "파일"]),
    "ip": ("prompt", ["read", "open", "show", "grep", "search", "find", "glob", "pattern", "list", "directory", "folder",
                      "file", "열어", "읽어", "보여", "찾아", "검색", "호출", "참조", "목록", "디렉토리", "폴더", "파일"]),
    "ic": ("context", ["read", "open", "grep", "search", "find", "glob", "list", "directory", "folder", "file",
                       "matches", "occurrences", "찾아", "검색", "호출", "참조", "목록", "디렉토리", "폴더", "파일"]),
    "mh": ("all", ["edit", "modify", "change", "update", "tweak", "patch", "write", "fix", "refactor", "replace",
                   "수정", "고쳐", "바꿔", "변경"]),
    "wh": ("all", ["write", "create file", "new file", "from scratch", "save", "새 파일", "작성", "만들"]),
    "nf": ("all", ["new file", "create", "add a file", "create file", "새 파일", "새로", "만들"]),
    "fix": ("all", ["fix", "bug", "broken", "error", "failing", "failed", "failure", "issue", "버그", "깨", "에러",
                    "실패"]),
    "ref": ("all", ["refactor", "cleanup", "clean up", "simplify", "restructure", "리팩터", "정리", "구조"]),
    "rep": ("all", ["replace", "rewrite", "swap", "rename", "substitute", "대체", "다시 써", "바꿔써"]),
    "mf": ("all", ["multiple files", "both", "all of", "across", "together", "두 파일", "전체", "같이", "한 번에"]),
    "vh": ("all", ["test", "tests", "pytest", "jest", "vitest", "spec", "go test", "cargo test", "lint", "eslint",
                   "ruff", "pylint", "clippy", "typecheck", "type check", "tsc", "mypy", "pyright", "build", "compile",
                   "docker", "image", "테스트", "린트", "타입", "정적분석", "빌드", "컴파일"]),
    "tc": ("all", ["typecheck", "type check", "tsc", "mypy", "pyright", "types", "타입", "정적분석"]),
    "bh": ("all", ["build", "compile", "docker", "image", "webpack", "vite build", "cargo build", "빌드", "컴파일"]),
    "run": ("all", ["run", "start", "serve", "execute", "script", "돌려", "실행", "띄워"]),
    "sh": ("all", ["bash", "shell", "terminal", "command", "cmd", "script", "명령", "스크립트", "쉘"]),
    "ci": ("all", ["ci", "workflow", "github actions", "action", "pipeline", "red", "green", "워크플로", "파이프라인"]),
    "rh": ("all", ["plan", "steps", "approach", "strategy", "outline", "break down", "explain", "ask", "question",
                   "latest", "docs", "should", "계획", "단계", "접근", "전략", "설명", "물어", "질문"]),
    "resp": ("all", ["answer", "respond", "tell me", "what is", "why", "explain", "summarize", "답변", "알려", "뭐야",
                     "왜", "설명"]),
    "ans": ("all", ["answer", "tell me", "what is", "why", "how does", "알려", "뭐야", "왜", "설명"]),
    "sum": ("all", ["summary", "summarize", "recap", "explain", "요약", "정리", "설명"]),
    "web": ("all", ["web", "internet", "online", "google", "browse", "latest", "recent", "current", "today", "docs",
                    "official", "version", "웹", "인터넷", "검색", "최신", "요즘", "오늘", "문서", "공식"]),
    "doc": ("all", ["docs", "documentation", "official", "reference", "api reference", "문서", "공식", "레퍼런스"]),
    "lat": ("all", ["latest", "recent", "today", "current", "newest", "version", "최신", "요즘", "오늘"]),
    "unc": ("all", ["not sure", "unclear", "ambiguous", "maybe", "confirm", "애매", "모르", "불확실", "확인"]),
    "cho": ("all", ["which", "choose", "option", "prefer", "or", "어느", "선택", "옵션", "뭐로"]),
    "ask": ("all", ["ask", "which", "choose", "confirm", "clarify", "ambiguous", "option", "should i", "do you want",
                    "물어", "질문", "확인", "어느", "선택"]),
    "plan": ("all", ["plan", "steps", "approach", "strategy", "outline", "break down", "before", "first", "계획", "단계",
                     "접근", "전략"]),
    "test": ("all", ["test", "tests", "pytest", "vitest", "jest", "spec", "cargo test", "go test", "테스트"]),
    "lint": ("all", ["lint", "eslint", "ruff", "pylint", "clippy", "typecheck", "type check", "tsc", "mypy", "린트",
                     "타입"]),
    "edit": ("all", ["edit", "modify", "change", "update", "tweak", "fix", "수정", "고쳐", "바꿔", "변경"]),
    "patch": ("all", ["patch", "diff", "apply", "apply patch", "multiple files", "both files", "패치", "한 번에",
                      "같이"]),
}
# Order in which hints are printed; those without a word list come from structure.
HINT_ORDER = [
    "ih", "ip", "ic", "path", "patt", "cmd", "nof", "hof", "rr", "rg", "rb", "rl", "mh", "wh", "nf", "fix", "ref", "rep",
    "mf", "vh", "tc", "bh", "run", "sh", "ci", "rh", "resp", "ans", "sum", "web", "doc", "lat", "unc", "cho", "ask",
    "plan", "test", "lint", "edit", "patch", "lp",
]


def keyword_tokens(text: Column) -> Column:
    """Names of the keyword groups with a hit, joined by blanks."""
    names = let(
        F.lower(text),
        lambda low: F.array_compact(F.array(*[F.when(has_any(low, words), name) for name, words in KEYWORD_GROUPS.items()])),
    )
    return F.array_join(names, " ")


def hint_flags(
    prompt_signal: Column, context_signal: Column, result_kind: Column,
    n_paths: Column, n_patterns: Column, n_cmds: Column, n_open: Column,
) -> Column:
    """The 41 'name=0/1' hints, joined by blanks."""
    texts = {
        "prompt": prompt_signal,
        "context": context_signal,
        "all": F.concat(prompt_signal, F.lit(" "), context_signal),
    }
    structural = {
        "path": n_paths > 0, "patt": n_patterns > 0, "cmd": n_cmds > 0, "nof": n_open == 0, "hof": n_open > 0,
        "rr": result_kind == "read", "rg": result_kind == "grep", "rb": result_kind == "glob", "rl": result_kind == "list",
        "lp": n_open == 0,
    }
    parts = []
    for name in HINT_ORDER:
        test = structural[name] if name in structural else has_any(texts[HINTS[name][0]], HINTS[name][1])
        if name == "mf":
            test = test | (n_paths >= 2)
        parts.append(F.concat(F.lit(f"{name}="), flag(test)))
    return F.concat_ws(" ", *parts)


def inspect_tokens(prompt: Column, history: Column) -> Column:
    """Tokens about what kind of inspection the prompt asks for and what is known already."""
    names = action_names(history)
    signals = F.struct(
        F.lower(compact(prompt, 2200)).alias("low"),
        F.size(find_all(compact(prompt, 2200), PATH_HINT)).alias("n_paths"),
        nth_last(names, 1).alias("last"),
        (F.size(names) > 0).alias("acted"),
        _newest_result(history).alias("result"),
        _newest_args(history).alias("args"),
    )
    return let(signals, _with_context)


def _newest_result(history: Column) -> Column:
    texts = F.filter(F.transform(items(history), lambda e: F.lower(compact(e["result_summary"], 500))), lambda t: t != "")
    return F.coalesce(F.get(texts, F.size(texts) - 1), F.lit(""))


def args_pairs(args: Column, sep: str, limit: int, shorten=compact) -> Column:
    """key<sep>value of each argument in insertion order."""
    return F.transform(
        F.coalesce(F.map_entries(args), F.array().cast("array<struct<key:string,value:string>>")),
        lambda e: F.concat(e["key"], F.lit(sep), shorten(_python_list(e["value"]), limit)),
    )


def _python_list(value: Column) -> Column:
    """List values in the notation ['a', 'b']; scalars unchanged."""
    parsed = F.from_json(value, "array<string>")
    shown = F.transform(parsed, lambda v: F.concat(F.lit("'"), v, F.lit("'")))
    return F.when(
        value.startswith("[") & parsed.isNotNull(), F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))
    ).otherwise(value)


def _newest_args(history: Column) -> Column:
    texts = F.filter(
        F.transform(items(history), lambda e: F.lower(F.array_join(args_pairs(e["args"], "=", 250), " "))), lambda t: t != ""
    )
    return F.coalesce(F.get(texts, F.size(texts) - 1), F.lit(""))


def _with_context(s: Column) -> Column:
    context = F.concat_ws(" ", F.lower(s["last"]), s["result"], s["args"])
    wider = F.struct(
        s["low"].alias("low"), s["n_paths"].alias("n_paths"), s["last"].alias("last"), s["acted"].alias("acted"),
        s["result"].alias("result"), context.alias("context"), F.size(find_all(context, PATH_HINT)).alias("n_found"),
        s["low"].contains("*").alias("wild"),
        has_any(s["low"], INTENTS["read"]).alias("read"), has_any(s["low"], INTENTS["search"]).alias("search"),
        has_any(s["low"], INTENTS["list"]).alias("list"),
        (s["low"].contains("*") | has_any(s["low"], INTENTS["glob"])).alias("glob"),
        has_any(s["low"], DEICTIC).alias("deictic"),
    )
    return let(wider, _tokens)


def _tokens(s: Column) -> Column:
    result, last = s["result"], s["last"]
    recent = {
        "listed": result.rlike(r"\b\d+\s+(entries|items)\b") | result.contains("listed"),
        "globbed": result.rlike(r"\b\d+\s+(files?\s+)?matched\b") | result.contains("files matched"),
        "grepped": result.rlike(r"\b\d+\s+(matches|occurrences)\b") | result.contains("found "),
        "read": result.contains("read ") | s["context"].contains("read_file"),
    }
    seen = s["n_found"] > 0
    for test in recent.values():
        seen = seen | test
    inspected = last.isin("read_file", "grep_search", "glob_pattern", "list_directory")
    known = (s["n_paths"] > 0) | (s["deictic"] & (inspected | seen))
    tokens = [
        F.when(s["n_paths"] > 0, "inspect_prompt_has_path"),
        F.when(s["n_paths"] > 0, F.concat(F.lit("inspect_prompt_path_count_"), band_float(s["n_paths"], [1, 2, 4]))),
        F.when(s["wild"], "inspect_prompt_has_wildcard"),
        F.when(s["read"], "inspect_intent_read"),
        F.when(s["search"], "inspect_intent_search"),
        F.when(s["list"], "inspect_intent_list"),
        F.when(s["glob"], "inspect_intent_glob"),
        F.when(s["deictic"], "inspect_deictic_target"),
        F.when(s["acted"], F.concat(F.lit("inspect_last_action_"), last)),
        F.when(s["n_found"] > 0, "inspect_recent_result_has_path"),
        F.when(
            s["n_found"] > 0, F.concat(F.lit("inspect_recent_result_path_count_"), band_float(s["n_found"], [1, 2, 4, 8]))
        ),
        *[F.when(test, f"inspect_recent_result_{name}") for name, test in recent.items()],
        F.when(known, "inspect_target_known"),
        F.when(s["search"] & ~known, "inspect_target_unknown_search"),
    ]
    for intent in ("read", "search", "list", "glob"):
        tokens.append(F.when(s[intent], F.concat(F.lit("inspect_combo_last_"), last, F.lit(f"_intent_{intent}"))))
        tokens.append(F.when(s[intent] & known, f"inspect_combo_known_intent_{intent}"))
    return F.array_compact(F.array(*tokens))


def python_bool(flag_col: Column) -> Column:
    """True / False, None for null."""
    return F.when(flag_col.isNull(), "None").when(flag_col, "True").otherwise("False")


def state_tokens(prompt: Column, history: Column, meta: Column) -> Column:
    """Session-state tokens plus the inspect tokens; tokens left open ('..._') are dropped."""
    ws = meta["workspace"]
    fixed = F.array(
        F.concat(F.lit("tier_"), compact(meta["user_tier"], 80)),
        F.concat(F.lit("lang_"), compact(meta["language_pref"], 80)),
        F.concat(F.lit("ci_"), compact(ws["last_ci_status"], 80)),
        F.concat(F.lit("dirty_"), python_bool(ws["git_dirty"])),
        F.concat(F.lit("turn_"), bin_floor(meta["turn_index"], 1)),
        F.concat(F.lit("budget_bin_"), bin_floor(meta["budget_tokens_remaining"], 10000)),
        F.concat(F.lit("elapsed_bin_"), bin_floor(meta["elapsed_session_sec"], 60)),
        F.concat(F.lit("loc_bin_"), bin_floor(ws["loc"], 5000)),
    )
    opened = F.transform(open_files(meta), lambda p: F.concat(F.lit("open_file_"), compact(p, 120)))
    langs = F.transform(
        F.coalesce(F.map_keys(ws["language_mix"]), F.array().cast("array<string>")),
        lambda k: F.concat(F.lit("langmix_"), compact(k, 40)),
    )
    every = F.concat(fixed, opened, langs, inspect_tokens(prompt, history))
    return F.filter(every, lambda t: (t != "") & ~t.endswith("_"))
