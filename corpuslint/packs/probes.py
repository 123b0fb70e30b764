"""Patterns of the text checks. ``needles`` are plain substrings of which a matching
text must contain at least one; they are tested on the raw bytes before the regex.
``folded`` are the same for patterns that ignore case, in lower case. ``ahead`` is an
optional look-ahead behind the pattern that fills further groups. ``lowered`` is a pattern that must occur in the text in
lower case; it has no classes that a removed character could fill."""

from __future__ import annotations

from typing import NamedTuple


# What stands between a quoted name and its quoted value.
ASSIGNED = r"""["']\s*[=:]\s*["']"""


class Pattern(NamedTuple):
    regex: str
    what: str = ""
    needles: tuple[str, ...] = ()
    folded: tuple[str, ...] = ()
    ahead: str = ""
    lowered: str = ""


# SEC001 family — name, pattern, severity, description, suggestion.
DANGEROUS = [
    ("eval", Pattern(r"\beval\s*\(", "使用eval()函数可能导致代码注入", ("eval",)), "critical",
     "避免使用eval()，考虑使用ast.literal_eval()解析字面量或重新设计代码逻辑"),
    ("exec", Pattern(r"\bexec\s*\(", "使用exec()函数可能导致代码注入", ("exec",)), "critical",
     "避免使用exec()，考虑使用其他安全的代码执行方式"),
    ("pickle", Pattern(r"pickle\.loads|pickle\.load", "使用pickle可能导致反序列化攻击", ("pickle.load",)),
     "high", "使用JSON代替pickle进行数据交换，或使用加密签名验证pickle数据"),
    ("yaml_load", Pattern(r"yaml\.load\s*\(", "yaml.load()默认不安全，可能导致代码执行", ("yaml.load",)),
     "high", "使用yaml.safe_load()代替yaml.load()"),
    ("subprocess_shell",
     Pattern(r"subprocess\.call\s*\([^)]*shell\s*=\s*True", "shell=True可能导致命令注入",
             ("subprocess.call",)),
     "high", "使用shell=False并传递参数列表，或对输入进行严格验证"),
    ("os_system", Pattern(r"os\.system\s*\(", "os.system()可能导致命令注入", ("os.system",)), "high",
     "使用subprocess模块并避免shell=True"),
    ("os_popen", Pattern(r"os\.popen\s*\(", "os.popen()可能导致命令注入", ("os.popen",)), "high",
     "使用subprocess.Popen并避免shell=True"),
    ("sql_raw", Pattern(r"execute\s*\([^)]*\+[^)]*\)", "SQL拼接可能导致SQL注入", ("execute",)), "critical",
     "使用参数化查询或ORM框架"),
    ("command_injection", Pattern(r"\|\s*os\.", "管道命令可能导致命令注入", ("|",)), "critical",
     "请审查此代码并确保安全的实现方式"),
    ("hardcoded_password",
     Pattern(r"""["'][^"']*(?:password|passwd|pwd|secret|api_key|apikey|token)[^"']*["']\s*[=:]\s*["']""",
             "硬编码密码/密钥存在安全风险",
             ("password", "passwd", "pwd", "secret", "api_key", "apikey", "token"), lowered=ASSIGNED),
     "high", "使用环境变量或安全的密钥管理服务"),
    ("insecure_hash", Pattern(r"md5\s*\(", "MD5不适合用于安全目的", ("md5",)), "medium",
     "使用hashlib.sha256()或hashlib.sha512()"),
    ("weak_crypto", Pattern(r"DES\.new|RC4", "使用弱加密算法", ("DES.new", "RC4")), "high",
     "使用现代加密算法如AES-256"),
    ("ssl_verify", Pattern(r"verify\s*=\s*False", "SSL验证被禁用，存在安全风险", ("verify",)), "high",
     "启用SSL验证，或使用自定义CA证书"),
    ("xss_raw_html", Pattern(r"dangerouslySetInnerHTML", "直接设置HTML可能导致XSS攻击",
                             ("dangerouslySetInnerHTML",)),
     "high", "使用文本插值或HTML转义库"),
    ("path_traversal", Pattern(r"\.\.[/\\]", "检测到路径遍历模式", ("../", "..\\")), "medium",
     "验证和规范化用户输入的路径"),
]

# The other security patterns by check.
SECURITY = {
    "SEC010": [
        Pattern(r"execute\s*\([^)]*\+[^)]*\)", "SQL查询使用字符串拼接", ("execute",)),
        Pattern(r"cursor\.execute\s*\([^)]*%[^)]*%[^)]*\)", "SQL查询使用%s格式化", ("cursor.execute",)),
        Pattern(r"""cursor\.execute\s*\([^)]*f["']""", "SQL查询使用f-string", ("cursor.execute",)),
        Pattern(r"cursor\.execute\s*\([^)]*\.format\s*\(", "SQL查询使用format()", ("cursor.execute",)),
        Pattern(r"\$\{?[a-zA-Z_][a-zA-Z0-9_]*\}?", "模板字符串中直接插入变量", ("$",)),
    ],
    "SEC011": [
        Pattern(r"innerHTML\s*=", "直接设置innerHTML可能导致XSS", ("innerHTML",)),
        Pattern(r"document\.write\s*\(", "document.write可能导致XSS", ("document.write",)),
        Pattern(r"eval\s*\([^)]*input|eval\s*\([^)]*params", "eval用户输入可能导致XSS", ("eval",)),
        Pattern(r"render\s*\(.*innerHTML", "使用innerHTML渲染可能导致XSS", ("innerHTML",)),
        Pattern(r"django\.utils\.html\.escape", "使用escape但可能不完整", ("django.utils.html.escape",)),
    ],
    "SEC012": [
        Pattern(r"subprocess\.[^:]+\([^)]*shell\s*=\s*True", "subprocess使用shell=True", ("subprocess.",)),
        Pattern(r"os\.system\s*\(", "os.system()调用", ("os.system",)),
        Pattern(r"os\.popen\s*\(", "os.popen()调用", ("os.popen",)),
        Pattern(r"\bspawn.*shell\s*=\s*True", "spawn shell=True", ("spawn",)),
        Pattern(r"commands\.getstatusoutput", "commands模块使用", ("commands.getstatusoutput",)),
        Pattern(r"\|\s*sh\b", "管道到shell脚本", ("|",)),
    ],
    "SEC013": [
        Pattern(r"""["'][^"']*(?:password|passwd|pwd|secret|api_key|api_key|apikey|token|auth_token|"""
                r"""access_token|private_key)[^"']*["']\s*[=:]\s*["'][^"']+["']""",
                "检测到硬编码的敏感信息", ('"', "'"),
                ("password", "passwd", "pwd", "secret", "api_key", "apikey", "token", "private_key"), lowered=ASSIGNED),
        Pattern(r"(?:github|aws|azure|gcp|stripe|sendgrid|mailgun)[_-]?(?:key|token|secret)",
                "检测到可能的API密钥",
                folded=("github", "aws", "azure", "gcp", "stripe", "sendgrid", "mailgun"),
                lowered=r"(?=[agms])(?:github|aws|azure|gcp|stripe|sendgrid|mailgun)[_-]?(?:key|token|secret)"),
        Pattern(r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----", "检测到私钥", ("-----",)),
    ],
    "SEC014": [
        Pattern(r"random\.random\s*\(", "random模块不是加密安全的", ("random.random",)),
        Pattern(r"random\.randint\s*\(", "random模块不是加密安全的", ("random.randint",)),
        Pattern(r"random\.choice\s*\(", "random模块不是加密安全的", ("random.choice",)),
    ],
    "SEC015": [
        Pattern(r"md5\s*\(", "MD5是已破解的哈希算法", ("md5",)),
        Pattern(r"sha1\s*\(", "SHA1是已弃用的哈希算法", ("sha1",)),
        Pattern(r"DES\.new\s*\(", "DES是不安全的加密算法", ("DES.new",)),
        Pattern(r"RC4\s*\(", "RC4是已破解的加密算法", ("RC4",)),
        Pattern(r"Cipher\.\w+MODE_ECB", "ECB模式是不安全的", ("MODE_ECB",)),
    ],
    "SEC016": [
        Pattern(r"\.\.[/\\]", "检测到路径遍历模式", ("../", "..\\")),
        Pattern(r"open\s*\([^)]*%s", "文件路径使用格式化可能存在路径遍历", ("%s",)),
        Pattern(r"os\.path\.join\s*\([^)]*\+[^)]*\)", "路径拼接可能存在安全问题", ("os.path.join",)),
    ],
    "SEC017": [
        Pattern(r"pickle\.load\s*\(", "pickle反序列化存在安全风险", ("pickle.load",)),
        Pattern(r"pickle\.loads\s*\(", "pickle反序列化存在安全风险", ("pickle.loads",)),
        Pattern(r"yaml\.load\s*\([^)]*Loader\s*=\s*yaml\.Loader\)", "不安全的YAML加载", ("yaml.Loader",)),
        Pattern(r"yaml\.unsafe_load\s*\(", "YAML unsafe_load存在安全风险", ("yaml.unsafe_load",)),
        Pattern(r"marshal\.load\s*\(", "marshal反序列化存在安全风险", ("marshal.load",)),
        Pattern(r"jsonpickle\.decode\s*\(", "jsonpickle可能存在安全风险", ("jsonpickle.decode",)),
    ],
    "SEC018": [
        Pattern(r"ET\.parse\s*\([^)]*parser\s*=\s*None", "XML解析可能存在XXE", ("ET.parse",)),
        Pattern(r"defusedxml", "检测到defusedxml，但使用方式可能不安全", ("defusedxml",)),
    ],
    "SEC020": [
        Pattern(r"Access-Control-Allow-Origin\s*:\s*\*", "CORS允许所有来源",
                ("Access-Control-Allow-Origin",)),
        Pattern(r"""allowedOrigins\s*=\s*\["\*"\]""", "CORS允许所有来源", ("allowedOrigins",)),
    ],
}
CREDENTIAL_SNIPPET = "[敏感信息已隐藏]"

# Quality patterns and limits.
FUNCTION_HEAD = r"(?:def|async\s+def)\s+(\w+)\s*\([^)]*\)\s*(?:->\s*\w+)?\s*:"
EMPTY_EXCEPT = (
    r"except\s*(?:\w+)?\s*(?:,\s*\w+)?\s*:\s*(?:pass|\.\.\.|\n\s*(?:#[^\n]*)?\s*$)"
)
HARDCODED = [
    Pattern(r"""["']https?://[^'"\s]+["']""", "可能的硬编码URL", ("http",)),
    Pattern(r"""["']/?[a-zA-Z0-9_/]+\.[a-zA-Z]{2,4}["']""", "可能的硬编码路径", ('"', "'")),
    Pattern(r"\b\d{4,}[/\-\.]?\d{0,2}[/\-\.]?\d{0,2}\b", "可能的硬编码日期/ID"),
]
NAME_STYLES = [
    r"\b[a-z][a-z0-9_]*\b",
    r"\b[a-z][a-z]*[A-Z][a-zA-Z]*\b",
    r"\b[A-Z][a-z]+[A-Z][a-zA-Z]*\b",
]
MAGIC_NUMBER = r"(?<![a-zA-Z_])([2-9]|[1-9][0-9]{2,})(?![a-zA-Z_])"
ORDINARY_NUMBERS = (0, 1, 2, 3, 4, 5, 10, 100, 1000, -1, 60, 24, 12, 365)
MAX_LINE_LENGTH = 120
MAX_FUNCTION_LINES = 50
MAX_NESTING = 4

# Best-practice patterns.
BARE_EXCEPT = r"except\s*:"
RERAISE = r"except.*:\s*raise"
OPENING_CALL = r"\.(connect|open|create)\s*\("
TYPED_FUNCTION = r"def\s+(\w+)\s*\([^)]*\)\s*(?::\s*(\w+))?\s*:"
PUBLIC_FUNCTION = r"def\s+([a-z][a-zA-Z0-9_]*)\s*\([^)]*\)\s*(?::\s*\w+)?\s*:"
FROM_IMPORT = r"from\s+(\S+)\s+import"
UPPERCASE_NAME = r"\b([A-Z][A-Z0-9_]+)\s*="
CONSTANT_WORDS = ("MAX", "MIN", "DEFAULT", "CONFIG", "SIZE")
MUTABLE_DEFAULT = r"def\s+\w+\s*\([^)]*=\s*(\[\]|\{\}|\w+\s*\[)"
PRINT_CALL = r"\bprint\s*\("
BOOL_COMPARISON = r"==\s*True|==\s*False"
VAR_KEYWORD = r"\bvar\s+"
LOOSE_EQUALITY = r"[^!]=[^=]|[^!]![^=]"
CONSOLE_LOG = r"console\.log\s*\("
TYPED_ANYWAY = ("__init__", "__str__", "__repr__")

# Performance patterns.
LOOP_START = r"^(for|while)\b"
STRING_APPEND = r"""\+=?\s*["']"""
STRING_CHAIN = r"""["'][^"']+\+["'][^"']+\+["']"""
LIST_COPY = r"(\w+)\s*=\s*(\w+)\s*\[:\s*\]"
MEMBERSHIP = r"\bif\s+\w+\s+in\s+\w+"
GLOBAL_NAME = r"\bglobal\s+\w+"
ATTRIBUTE = r"(\w+\.\w+)"
REGEX_CALL = r"re\.(compile|search|match|findall)"
QUERY_CALL = (
    r"\.query\s*\(|\.filter\s*\(|\.all\s*\(|\.get\s*\(|cursor\.execute|\.find\s*\(|\.select\s*\("
)
LENGTH_OF_RANGE = r"len\s*\(\s*list\s*\(\s*range\s*\("
PURE_FUNCTION = r"def\s+(\w+)\s*\([^)]*\)\s*(?::\s*\w+)?\s*:"

# Documentation patterns.
DOCUMENTED_FUNCTION = r"""def\s+(\w+)\s*\(([^)]*)\)\s*(?::\s*([\w\[\],\s|]+))?\s*:\s*(['"])?"""
DOCUMENTED_ANYWAY = (
    "__init__", "__str__", "__repr__", "__call__",
    "__enter__", "__exit__", "__getitem__", "__setitem__",
)
DOCUMENTED_CLASS = r"""class\s+(\w+)(?:\([^)]*\))?\s*:\s*(['"])?"""
ARGUMENT_WORDS = ("Args", "Arguments", "Parameters", "参数")
RETURN_WORDS = ("Return", "返回")
HEADER_WORDS = ("copyright", "license", "author", "@author")
EMPTY_COMMENTS = [
    r"^\s*#.*\b(the|a|an)\s+\w+\s*$",
    r"^\s*#.*\b(and|or|but)\s+\w+\s*$",
    r"^\s*#\s*(ok|okay|yes|no)\s*$",
    r"^\s*#.*(?<![a-zA-Z])([a-z])\s*$",
]
TODO_WORDS = [
    Pattern(r"\bTODO\b", "TODO注释", folded=("todo",)),
    Pattern(r"\bFIXME\b", "FIXME注释", folded=("fixme",)),
    Pattern(r"\bHACK\b", "HACK注释", folded=("hack",)),
    Pattern(r"\bXXX\b", "XXX注释", folded=("xxx",)),
    Pattern(r"\bBUG\b", "BUG注释", folded=("bug",)),
]
API_ROUTES = [
    Pattern(r"@app\.(route|get|post|put|delete|patch)", "Flask路由", ("@app.",)),
    Pattern(r"@router\.(get|post|put|delete|patch)", "FastAPI路由", ("@router.",)),
    Pattern(r"""def\s+\w+\s*\([^)]*\):\s*(?:->\s*\w+\s*)?\s*["']{3}""", "FastAPI端点", ("def",)),
    Pattern(r"""@\w+\.route\s*\(["']""", "Express路由", (".route",)),
    Pattern(r"@\w+\.(Get|Post|Put|Delete|Patch)\s*\(", "NestJS路由",
            (".Get", ".Post", ".Put", ".Delete", ".Patch")),
]
DOC_MARKS = ('"""', "'''", "//", "/**")
README_TITLE = r"^#\s+\w+"
README_PARTS = ("缺少标题", "缺少安装说明", "缺少使用示例", "缺少许可证信息")

# File suffixes each analyzer reads.
SUFFIXES = {
    "quality": (".py", ".js", ".ts", ".java", ".c", ".cpp", ".go", ".rs"),
    "best_practices": (".py", ".js", ".ts", ".java", ".go", ".rs"),
    "security": (".py", ".js", ".ts", ".java", ".go", ".rb", ".php"),
    "performance": (".py", ".js", ".ts", ".java", ".go", ".rs"),
    "documentation": (".py", ".js", ".ts", ".java", ".go", ".md", ".rst"),
    "skills": (".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rs", ".c", ".cpp"),
    "java": (".java", ".xml", ".properties", ".yml", ".yaml", ".gradle"),
}
