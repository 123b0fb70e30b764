"""Random source-like texts: lines of the sample templates, fragments and odd characters."""

import random

from corpuslint.sources.samples import TEMPLATES

FRAGMENTS = [
    "def ", "async def ", "foo", "_bar", "__init__", "(", ")", "):", " -> int:", ": str:", "[]", "{}", "=", " == True",
    "\n", "\n    ", "\n        ", "\n\n", "\n\t", "for x in y:", "while z:", "return", "return x", "if a in b", "global k",
    '"""', "'''", '"', "'", "+", "+=", "eval(", "exec (", "os.system(", "| os.", "|sh", "import ", "from a import b",
    "from a.b import c", "MAX_SIZE = ", "DEFAULT_X=", "CONFIG =Y", "é", "中", "été", "\u00a0", "\x0b", "\x1c", "\u2028", "1", "7", "42",
    "150", "12345", "2020-01-02", "http://x.y", "'a/b.txt'", "TODO", "fixme", "Bug", "HACKS", "class Foo:", "class _X(object):",
    "@app.route", "@router.get", "@x.route('", "@A.Get(", "# the end", "# ok", "# a", "#", "//", "Args", "Returns", "返回",
    "except:", "except ValueError: raise", "except E:\n    pass", "print(", "append", "range(", "len(list(range(", "re.match(",
    ".filter(", "a.b", "password", "'token': '", "md5(", "RC4(", "../", "$name", "${x}", "console.log(", "var ", "!", "\u0001",
]


def random_text(rng: random.Random) -> str:
    parts = []
    for _ in range(rng.randint(0, 30)):
        if rng.random() < 0.3:
            lines = rng.choice(TEMPLATES)[1].split("\n")
            parts.append(rng.choice(lines) + "\n")
        else:
            parts.append(rng.choice(FRAGMENTS))
        if rng.random() < 0.2:
            parts.append(" ")
    return "".join(parts)


def random_lines(rng: random.Random) -> str:
    """Short programs for the checks that follow line order."""
    stems = [
        "def f():", "for a in b:", "while c:", "return 1", "x = 1", "", "# note", 's += "t"', "q.find(x.y)", "use(x.y, x.z)",
        'm = re.search("a", x.y)', "foreword for all", "import os", "from a import b", "value_number_one = 12345", "print(x)",
        "the_same_long_line_of_code()", "another_rather_long_line_here()", "return", "    ", "\t",
    ]
    if rng.random() < 0.4:
        stems = [*stems, *["for a in b:", "while c:"] * 8]
    indents = ["", "", "    ", "    ", "        ", "  ", "\t"]
    return "\n".join(rng.choice(indents) + rng.choice(stems) for _ in range(rng.randint(0, 25)))
