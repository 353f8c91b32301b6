"""Shell commands as column expressions: the programs that ran, what joined them, background and completeness.

A command is cut by one pattern into comments, redirects, operators and words, and folded over these pieces. Quotes,
substitutions and here-document bodies are part of words or taken out, so an operator inside them parts nothing. This covers a
documented part of the grammar: loops, groups, function bodies and the branches of a `case` are read for the commands inside them, names of functions
and patterns of a `case` are no commands, and substitutions are not looked into.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arguments import type_word
from .strings import let

# fixed values
WRAPPERS = ["sudo", "env", "time", "nohup", "exec", "command", "builtin", "nice", "ionice", "stdbuf", "timeout", "watch", "setsid", "caffeinate", "xargs", "rtk"]
VALUE_FLAGS = ["-u", "-g", "-p", "-C", "-h", "-w", "-n", "--user", "--group", "-I", "-S"]
SUBCOMMANDS = [
    "git", "npm", "npx", "pnpm", "yarn", "pip", "cargo", "docker", "podman", "docker-compose", "kubectl", "helm", "go", "apt", "apt-get", "brew", "poetry", "uv", "conda", "gh", "systemctl", "make",
    "terraform", "gcloud", "aws", "rustup", "deno", "bun", "dotnet", "mvn", "gradle", "rails", "bundle", "composer", "gem", "dvc", "pre-commit", "pdm", "rye", "pipx", "hatch", "module", "svn", "hg",
]
RUNNERS = ["uv", "poetry", "pdm", "rye", "pipx", "hatch", "conda"]
SOURCE_WORDS = [
    "import", "from", "def", "class", "with", "except", "try", "finally", "raise", "assert", "lambda", "global", "nonlocal", "del", "pass", "yield", "await", "async", "const", "let", "var", "console",
    "require", "print", "self", "this",
]
SPELLINGS = {"python3": "python", "python2": "python", "py": "python", "pip3": "pip", "node18": "node", "nodejs": "node"}
GLUED = [
    "mysql", "mysqldump", "mysqladmin", "mysqlimport", "mysqlshow", "mysqlcheck", "mariadb", "mariadb-dump", "mariadb-admin", "sshpass", "sqlcmd", "bcp", "isql", "sqlplus", "mongo", "mongosh", "mongodump",
    "mongorestore", "smbclient", "htpasswd", "redis-cli", "psql", "pg_dump", "pg_restore", "pg_dumpall",
]
ASSIGNMENT = r"^[A-Za-z_][A-Za-z0-9_]*="
DURATION = r"^[0-9.]+[smh]?$"
PROGRAM = r"^[A-Za-z0-9_][A-Za-z0-9_.\-]*$"
SUBCOMMAND = r"^[A-Za-z][A-Za-z0-9:_-]*$"

#: Words that open or close a loop, a condition or a group: a command follows the first, none the second.
OPENING, CLOSING = ["if", "then", "else", "elif", "while", "until", "do", "!"], ["fi", "done", "esac", "for", "case", "select", "function", "in"]
_COMMENT = r"#[^\n]*+"
_REDIRECT = r"\d*+(?:[<>]&(?:\d++-?|-)|<<<|<<-?|<>|>>|>\||[<>]&?)|&>>?"
_OPERATOR = r"&&|\|\||\|&|\||;;?|&|\n|[()]"
_OPERATORS = ("&&", "||", "|&", "|", ";", ";;", "&", "\n", "(", ")", "{", "}")
# possessive loops, which the engine runs without recursion
_WORD = r"""(?:[^\s'"\\;&|<>()`$]++|\\[\s\S]|'[^']*+'|"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|\$\((?:[^()]++|\([^()]*+\))*+\)|`[^`]*+`|\$|['"`][\s\S]*+|\\)++"""
_PIECE = rf"({_COMMENT}|{_REDIRECT}|{_OPERATOR}|{_WORD})"
_HERE_DOCUMENT = r"(<<-?[ \t]*+(['\"]?)(\w++)\2[^\n]*+)\n(?:[^\n]*+\n)*?[ \t]*+\3[ \t]*+(?=\n|\z)"
#: A quoted text, or the head of a function's definition where a command may begin.
_FUNCTION = r"""("[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|'[^']*+')|(?<=^|[;&|\n{(])([ \t]*+(?:function[ \t]++)?)[A-Za-z_][\w.:-]*+[ \t]*+\([ \t]*+\)"""
_BALANCED = r"""^(?:[^'"\\`]++|\\[\s\S]|'[^']*+'|"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|`[^`]*+`)*+$"""

_EMPTY = "array<string>"
_RUN = "array<struct<joined:string,words:array<string>,redirects:array<string>,here:boolean,background:boolean>>"


def _unquoted(word: Column) -> Column:
    whole = (word.startswith("'") | word.startswith('"')) & word.rlike(r"""^(?:'[^']*'|"[^"]*")$""")
    return F.when(whole, F.substring(word, F.lit(2), F.length(word) - 2)).otherwise(word)


def commands(command: Column) -> Column:
    """run: simple commands in order, with the operator before each, its words without redirects, the words of its redirects, and whether
    it opens a here-document or runs in the background; and whether any runs in the background."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(command, r"\\\n", " "), _HERE_DOCUMENT, "$1"), _FUNCTION, "$1")
    start = F.struct(F.array().cast(_RUN).alias("run"), F.array().cast(_EMPTY).alias("words"), F.array().cast(_EMPTY).alias("redirects"), F.lit(False).alias("here"), F.lit(False).alias("marker"), F.lit("").alias("joined"), F.lit(False).alias("target"), F.lit(False).alias("background"), F.lit(False).alias("pattern"))

    def step(a: Column, piece: Column) -> Column:
        text, operator = piece["text"], piece["operator"]
        # in a case, what stands before the bracket of a branch is its pattern
        pattern = a["pattern"] & (text != "esac")
        redirect = ~operator & ~pattern & piece["redirect"]
        word = ~operator & ~pattern & ~piece["redirect"] & ~piece["comment"]
        opens = redirect & piece["here"]
        some = F.size(a["words"]) > 0
        done = F.struct(a["joined"].alias("joined"), a["words"].alias("words"), a["redirects"].alias("redirects"), a["here"].alias("here"), (text == "&").alias("background"))
        closed = F.concat(a["run"], F.array(done).cast(_RUN))
        # redirects and & after a group belong to its last command
        late = operator & ~some & (F.size(a["run"]) > 0) & ((F.size(a["redirects"]) > 0) | a["here"] | (text == "&"))
        last = F.get(a["run"], F.size(a["run"]) - 1)
        grown = F.struct(last["joined"].alias("joined"), last["words"].alias("words"), F.concat(last["redirects"], a["redirects"]).alias("redirects"), (last["here"] | a["here"]).alias("here"), (last["background"] | (text == "&")).alias("background"))
        grouped = F.concat(F.slice(a["run"], 1, F.size(a["run"]) - 1), F.array(grown).cast(_RUN))
        joins = F.when(text.isin("|", "|&"), "|").when(text.isin("&&", "||"), text).when(text.isin(";", ";;"), ";").otherwise("")
        return F.struct(
            F.when(operator & some, closed).when(late, grouped).otherwise(a["run"]).alias("run"),
            F.when(operator, F.array().cast(_EMPTY)).when(word & ~a["target"], F.array_append(a["words"], piece["bare"])).otherwise(a["words"]).alias("words"),
            F.when(operator, F.array().cast(_EMPTY)).when((redirect & ~opens) | (word & a["target"] & ~a["marker"]), F.array_append(a["redirects"], piece["bare"])).otherwise(a["redirects"]).alias("redirects"),
            ((a["here"] & ~operator) | opens).alias("here"),
            opens.alias("marker"),
            # a line break or a bracket after an operator leaves that operator in force
            F.when(operator & (some | ~text.isin("\n", "(", "{")), joins).otherwise(a["joined"]).alias("joined"),
            F.when(redirect, piece["aims"]).when(word | operator, False).otherwise(a["target"]).alias("target"),
            (a["background"] | ((text == "&") & (some | (F.size(a["run"]) > 0)))).alias("background"),
            F.when(text.isin(")", "esac"), False).when((text == ";;") | (operator & (F.get(a["words"], 0) == "case") & (F.try_element_at(a["words"], F.lit(-1)) == "in")), True).otherwise(a["pattern"]).alias("pattern"),
        )

    # patterns are tried once a piece, before the fold, whose expressions stand in many places of a step
    redirected = lambda p: (F.contains(p, F.lit("<")) | F.contains(p, F.lit(">"))) & p.rlike(rf"^(?:{_REDIRECT})$")
    known = lambda p, redirect: F.struct(p.alias("text"), p.isin(*_OPERATORS).alias("operator"), redirect.alias("redirect"), p.startswith("#").alias("comment"), (redirect & p.isin("<<", "<<-")).alias("here"), (redirect & ~p.rlike(r"&(?:\d+-?|-)$")).alias("aims"), _unquoted(p).alias("bare"))
    pieces = F.transform(F.concat(F.regexp_extract_all(bare, F.lit(_PIECE), 1), F.array(F.lit("\n"))), lambda p: known(p, redirected(p)))
    return F.aggregate(pieces, start, step, lambda a: F.struct(a["run"].alias("run"), a["background"].alias("background")))


def program_name(word: Column) -> Column:
    """A program without folder and .exe, spellings of interpreters folded."""
    spelt = F.create_map(*(F.lit(x) for kv in SPELLINGS.items() for x in kv))
    # patterns are tried only on words that may hold them
    inside = F.when(F.contains(word, F.lit("/")) | F.contains(word, F.lit("\\")), F.regexp_extract(word, r"([^/\\]*)$", 1)).otherwise(word)
    bare = let(inside, lambda n: F.when(F.contains(n, F.lit(".exe")), F.regexp_replace(n, r"\.exe$", "")).otherwise(n))
    return let(bare, lambda n: F.when(F.startswith(n, F.lit("python")) & n.rlike("^python[0-9.]+$"), "python").otherwise(F.coalesce(spelt[n], n)))


def prefix_size(words: Column) -> Column:
    """How many assignments, wrappers with their options, and opening words stand before the program."""
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("over"), F.lit(False).alias("wrapped"), F.lit(False).alias("value"))

    def step(a: Column, w: Column) -> Column:
        def of(wrapper: Column) -> Column:
            option = a["wrapped"] & (w.rlike("^-.+") | w.rlike(DURATION))
            inside = a["value"] | wrapper | w.isin(*OPENING) | w.rlike(ASSIGNMENT) | option
            return let(inside, lambda inside: F.struct((a["n"] + inside.cast("int")).alias("n"), (~inside).alias("over"), (a["wrapped"] | wrapper).alias("wrapped"), (inside & ~a["value"] & a["wrapped"] & w.isin(*VALUE_FLAGS)).alias("value")))

        return F.when(a["over"], a).otherwise(let(program_name(w).isin(*WRAPPERS), of))

    return F.aggregate(words, start, step, lambda a: a["n"])


def _after_prefix(words: Column, size: Column) -> Column:
    return F.slice(words, size + 1, F.greatest(F.size(words), F.lit(1)))


def _label(rest: Column, name: Column) -> Column:
    """The label of a command's words from its program on, with that program's name."""
    first, second = F.get(rest, 0), F.get(rest, 1)
    plain = F.filter(F.slice(rest, 2, F.greatest(F.size(rest), F.lit(1))), lambda w: w.rlike(SUBCOMMAND))
    python = F.when((second == "-m") & (F.size(rest) > 2), F.concat(F.lit("python -m "), F.get(rest, 2))).when(second == "-c", "python -c").otherwise("python")
    taken = lambda plain: F.when(name.isin(*RUNNERS) & (F.get(plain, 0) == "run"), 2).otherwise(1)
    sub = let(plain, lambda plain: F.when(F.size(plain) > 0, F.concat_ws(" ", F.concat(F.array(name), F.slice(plain, 1, taken(plain))))).otherwise(name))
    none = (F.size(rest) == 0) | first.isin(*SOURCE_WORDS, *CLOSING) | F.coalesce(second == "=", F.lit(False)) | ~name.rlike(PROGRAM)
    return F.when(none, None).when(name == "python", python).when(name.isin(*SUBCOMMANDS), sub).otherwise(name)


def _rest(rest: Column, name: Column) -> Column:
    """The words after the program that its label does not name."""

    def of(after: Column) -> Column:
        module = F.when((F.get(after, 0) == "-m") & (F.size(after) > 1), 2).when(F.get(after, 0) == "-c", 1).otherwise(0)

        def named(places: Column) -> Column:
            taken = F.when(name.isin(*RUNNERS) & (F.get(after, F.get(places, 0)) == "run"), 2).otherwise(1)
            return let(F.slice(places, 1, taken), lambda used: F.filter(after, lambda w, i: ~F.array_contains(used, i)))

        places = F.filter(F.transform(after, lambda w, i: F.when(w.rlike(SUBCOMMAND), i)), lambda i: i.isNotNull())
        return F.when(name == "python", let(module, lambda m: F.filter(after, lambda w, i: i >= m))).when(name.isin(*SUBCOMMANDS), let(places, named)).otherwise(after)

    return let(F.slice(rest, 2, F.greatest(F.size(rest), F.lit(1))), of)


def label(words: Column) -> Column:
    """What ran: the program, with its subcommand or module where that says more; null where no program did."""
    return let(_after_prefix(words, prefix_size(words)), lambda rest: let(program_name(F.get(rest, 0)), lambda name: _label(rest, name)))


def _typed(c: Column) -> Column:
    """A simple command with its values erased: assignments and wrappers' values, the label as it is, arguments, redirects."""

    def before(w: Column) -> Column:
        return F.when(w.rlike(ASSIGNMENT), "<assign>").when(program_name(w).isin(*WRAPPERS), program_name(w)).otherwise(type_word(w))

    def after(words: Column) -> Column:
        # lowering is costly, so it is done where the word is one of these but for its case
        like = lambda n: n.rlike(rf"(?iu)^(?:{'|'.join(GLUED)})$") & F.lower(n).isin(*GLUED)
        glues = lambda w: let(program_name(w), like)
        own = glues(F.split(c["label"], " ")[0])
        # a program named among the arguments (`docker exec db mysql -proot`) makes the flags after it its own
        first = F.when(own, 1).otherwise(F.array_position(F.transform(words, glues), True).cast("int"))
        return let(first, lambda first: F.transform(words, lambda w, i: type_word(w, (first > 0) & (i + 1 >= first))))

    kept = F.filter(c["before"], lambda w: ~w.isin(*OPENING))
    parts = F.concat(F.transform(kept, before), F.array(c["label"]), let(F.concat(c["rest"], c["redirects"]), after), F.when(c["here"], F.array(F.lit("<heredoc>"))).otherwise(F.array().cast(_EMPTY)))
    return F.array_join(parts, " ")


def _skeleton(ran: Column) -> Column:
    """Typed commands with the operators between them; a line break counts as `;`."""

    def placed(c: Column, i: Column) -> Column:
        between = F.when(F.get(ran, i - 1)["background"], "&").otherwise(F.coalesce(F.nullif(c["joined"], F.lit("")), F.lit(";")))
        return F.concat(F.when(i == 0, "").otherwise(F.concat(between, F.lit(" "))), _typed(c))

    end = F.when(F.get(ran, F.size(ran) - 1)["background"], " &").otherwise("")
    return F.when(F.size(ran) > 0, F.concat(F.array_join(F.transform(ran, placed), " "), end))


def programs(command: Column, skeleton: bool = False) -> Column:
    """programs, joined_by, background, wrappers (words before each program) and parse_status of a command, and skeleton (its
    commands with values erased; null without a program) where asked for; null for null."""

    def run(c: Column) -> Column:
        def of(size: Column) -> Column:
            return let(_after_prefix(c["words"], size), lambda rest: let(program_name(F.get(rest, 0)), lambda name: named(size, rest, name)))

        def named(size: Column, rest: Column, name: Column) -> Column:
            more = [_rest(rest, name).alias("rest"), c["redirects"].alias("redirects"), c["here"].alias("here"), c["background"].alias("background")] if skeleton else []
            return F.struct(_label(rest, name).alias("label"), c["joined"].alias("joined"), F.slice(c["words"], 1, size).alias("before"), *more)

        return let(prefix_size(c["words"]), of)

    def of(read: Column) -> Column:
        ran = F.transform(read["run"], run)
        status = F.when(command.rlike(_BALANCED), "success").otherwise("partial")
        return let(F.filter(ran, lambda c: c["label"].isNotNull()), lambda ran: F.struct(
            F.transform(ran, lambda c: c["label"]).alias("programs"), F.transform(ran, lambda c, i: F.when(i == 0, "").otherwise(c["joined"])).alias("joined_by"), read["background"].alias("background"),
            F.flatten(F.transform(ran, lambda c: c["before"])).alias("wrappers"), status.alias("parse_status"), *([_skeleton(ran).alias("skeleton")] if skeleton else []),
        ))

    return F.when(command.isNotNull(), let(commands(command), of))
