"""A tokenizer and single-pass structure reader for TypeScript text.

It builds no tree: brackets get a role when they open, type annotations are stepped over, and functions,
decisions, nesting and imports are read from the tokens.  Text inside JSX elements is read as tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Reserved words and primitive type names, each a token kind of its own.
RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with implements interface let package private protected public static yield await async of as from readonly".split())
PRIMITIVES = frozenset("any bigint boolean never number object string symbol undefined unknown".split())
# Words that open a decision, and operators that are one.
BRANCH_WORDS = frozenset(("if", "for", "while", "do", "case", "catch"))
BRANCH_OPERATORS = frozenset(("&&", "||", "??", "&&=", "||=", "??=", "?."))
NESTING_WORDS = frozenset(("if", "for", "while", "do", "switch", "try"))
LITERAL, IDENTIFIER, EMPTY_LIST = "<literal>", "<identifier>", "<empty>"

_PUNCTUATION = ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ++ -- += -= *= /= %= &= |= ^= << >> ** ?.".split()
_LEX = re.compile(
    r"(?P<space>[^\S\n]+|\n|﻿)|(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)"
    r"|(?P<word>[A-Za-z_$#\u0080-\U0010ffff][\w$]*)"
    r"|(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"
    r"|(?P<string>\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"
    r"|(?P<mark>" + "|".join(map(re.escape, _PUNCTUATION)) + r"|[{}()\[\];,<>+\-*/%&|^!~?:=.@])"
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_CLOSE = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Token:
    kind: str
    text: str
    line: int
    end_line: int


@dataclass
class Source:
    tokens: list[Token] = field(default_factory=list)
    code_lines: set[int] = field(default_factory=set)
    comment_lines: set[int] = field(default_factory=set)
    total_lines: int = 1
    problems: list[str] = field(default_factory=list)
    partner: dict[int, int] = field(default_factory=dict)


def tokenize(text: str) -> Source:
    """Tokens, the lines that hold code or comments, and what doesn't lex or balance."""
    src = Source(total_lines=text.count("\n") + 1)
    at, line, templates, depth = 0, 1, [], 0
    if text.startswith("#!"):
        at = len(text.split("\n", 1)[0])
        src.comment_lines.add(1)

    def put(kind: str, value: str) -> None:
        nonlocal at, line
        last = line + value.count("\n")
        src.tokens.append(Token(kind, value, line, last))
        src.code_lines.update(range(line, last + 1))
        at, line = at + len(value), last

    def template(opening: str) -> None:
        nonlocal depth
        body = _TEMPLATE.match(text, at + 1).end()
        if text.startswith("${", body):
            templates.append(depth)
            put(LITERAL, text[at : body + 2])
        elif text.startswith("`", body):
            put(LITERAL, text[at : body + 1])
        else:
            src.problems.append(f"unterminated template at line {line}")
            put(LITERAL, text[at:])

    while at < len(text):
        if text[at] == "`":
            template("`")
            continue
        if text[at] == "}" and templates and templates[-1] == depth:
            templates.pop()
            template("}")
            continue
        if text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*") and _regex_may_start(src.tokens):
            m = _REGEX.match(text, at)
            if m:
                put(LITERAL, m.group())
                continue
        m = _LEX.match(text, at)
        if m is None:
            src.problems.append(f"unexpected character at line {line}")
            at += 1
            continue
        kind, value = m.lastgroup, m.group()
        if kind == "space":
            line, at = line + value.count("\n"), m.end()
        elif kind == "comment":
            last = line + value.count("\n")
            src.comment_lines.update(range(line, last + 1))
            line, at = last, m.end()
        elif kind == "word":
            own = (value in RESERVED or value in PRIMITIVES) and not (src.tokens and src.tokens[-1].text in (".", "?."))
            put(value if own else IDENTIFIER, value)
        elif kind in ("string", "number"):
            put(LITERAL, value)
        else:
            if value == "?." and text[m.end() : m.end() + 1].isdigit():
                value = "?"
            depth += (value == "{") - (value == "}")
            put(value, value)
    if templates:
        src.problems.append("unterminated template")
    _pair(src)
    return src


def _regex_may_start(tokens: list[Token]) -> bool:
    if not tokens:
        return True
    last = tokens[-1]
    return not (last.kind in (IDENTIFIER, LITERAL, ")", "]", "}", "this", "super", "true", "false", "null", "++", "--") or last.kind in PRIMITIVES)


def _pair(src: Source) -> None:
    open_at: list[int] = []
    for i, t in enumerate(src.tokens):
        if t.kind in _CLOSE:
            open_at.append(i)
        elif t.kind in (")", "]", "}"):
            if not open_at or _CLOSE[src.tokens[open_at[-1]].kind] != t.kind:
                src.problems.append(f"unbalanced {t.kind} at line {t.line}")
                continue
            j = open_at.pop()
            src.partner[i], src.partner[j] = j, i
    for i in open_at:
        src.problems.append(f"unclosed {src.tokens[i].kind} at line {src.tokens[i].line}")
    binary = {"=", "+", "*", "/", "%", "&&", "||", "??", "==", "===", "!=", "!==", "<=", ">=", ".", "=>"}
    for a, b in zip(src.tokens, src.tokens[1:], strict=False):
        if a.kind in binary and b.kind in (";", ")", "]", "}"):
            src.problems.append(f"expression expected at line {b.line}")


def normalised(src: Source) -> list[tuple[str, int, int]]:
    """kind, line, end line of the leaves that repetition is measured over: an empty list between brackets is
    a leaf too."""
    out, previous = [], None
    for i, t in enumerate(src.tokens):
        if previous is not None and (previous.kind, t.kind) in (("(", ")"), ("{", "}"), ("[", "]")):
            before = src.tokens[i - 2].kind if i > 1 else ""
            if t.kind != "]" or not (before in (IDENTIFIER, ")", "]", ">", "}") or before in PRIMITIVES):
                out.append((EMPTY_LIST, t.line, t.line))
        out.append((t.kind, t.line, t.end_line))
        previous = t
    return out


class Reader:
    """Functions, decisions and imports of one token sequence."""

    def __init__(self, src: Source):
        self.src, self.t, self.n = src, src.tokens, len(src.tokens)
        self.functions: list[dict] = []
        self.signatures = 0
        self.overloads: dict[tuple[int, str], int] = {}
        self.typed: set[int] = set()  # tokens of annotations
        self.colons: dict[int, str] = {}
        self.roles: dict[int, str] = {}
        self.imports: list[dict] = []
        self.read()

    def kind(self, i: int) -> str:
        return self.t[i].kind if 0 <= i < self.n else ""

    def close(self, i: int) -> int:
        return self.src.partner.get(i, self.n - 1)

    # --- types

    def skip_type(self, i: int) -> int:
        """The index after the type that starts at ``i``."""
        start = i
        while self.kind(i) in ("|", "&"):
            i += 1
        while True:
            while self.t[i].text in ("keyof", "typeof", "readonly", "unique", "infer", "asserts", "new", "abstract") if i < self.n else False:
                i += 1
            k = self.kind(i)
            if k == "<":
                i = self.skip_angles(i) or i + 1
                continue
            if k == "(":
                i = self.close(i) + 1
                if self.kind(i) == "=>":
                    i = self.skip_type(i + 1)
            elif k in ("{", "["):
                i = self.close(i) + 1
            elif k == "-" or k == LITERAL:
                i += 1 if k == LITERAL else 2
            elif k == IDENTIFIER or k in PRIMITIVES or k in ("void", "null", "this", "true", "false", "import"):
                i += 1
                if k == "import" and self.kind(i) == "(":
                    i = self.close(i) + 1
                while self.kind(i) == ".":
                    i += 2
                if self.kind(i) == "<":
                    i = self.skip_angles(i) or i
            else:
                break
            while self.kind(i) == "[" and self.t[i].line == self.t[i - 1].end_line:
                i = self.close(i) + 1
            if i < self.n and self.t[i].text == "is":
                i += 1
                continue
            if self.kind(i) in ("|", "&"):
                i += 1
                continue
            if self.kind(i) == "extends":
                i = self.skip_type(i + 1)
                if self.kind(i) == "?":
                    i = self.skip_type(i + 1)
                    if self.kind(i) == ":":
                        i = self.skip_type(i + 1)
            break
        self.typed.update(range(start, i))
        return max(i, start)

    def skip_angles(self, i: int) -> int | None:
        """The index after ``<...>`` at ``i`` if it holds types, else None."""
        j, depth = i + 1, 1
        while j < self.n and depth:
            k = self.kind(j)
            if k in ("(", "[", "{"):
                j = self.close(j)
            elif k == "<":
                depth += 1
            elif k in (">", ">>", ">>>"):
                depth -= len(k)
            elif k in (";", "&&", "||", ")", "]", "}", "==", "===", "+", "-", "*"):
                return None
            j += 1
        return j if depth <= 0 else None

    # --- brackets and functions

    def role_of_brace(self, i: int, container: str, header: str) -> str:
        before = self.kind(i - 1)
        if header:
            return header
        if before in ("import", "export", "type") or (before == "," and container == "names"):
            return "names"
        if before in ("=", "(", ",", "[", "?", "return", "...", "&&", "||", "??", "in", "of", "yield", "await", "throw", "typeof", "as", "<", "+", "extends"):
            return "object"
        if before == ":":
            return "object" if self.colons.get(i - 1) in ("property", "ternary") else "block"
        return "block"

    def read(self) -> None:
        stack: list[dict] = [{"role": "block", "ternary": 0, "case": 0, "at": -1, "close": self.n}]
        i, header = 0, ""
        while i < self.n:
            k, here = self.kind(i), stack[-1]
            word = self.t[i].text
            if i in self.typed:
                i += 1
                continue
            if k in ("class", "interface", "enum") and self.kind(i - 1) not in (".", "?."):
                header = {"class": "class", "interface": "type", "enum": "object"}[k]
            elif word in ("namespace", "module") and self.kind(i + 1) in (IDENTIFIER, LITERAL):
                header = "block"
            elif k == IDENTIFIER and word == "type" and self.kind(i + 1) == IDENTIFIER and self.kind(i - 1) in ("", ";", "{", "}", "export", IDENTIFIER, LITERAL, ")"):
                j = i + 2
                if self.kind(j) == "<":
                    j = self.skip_angles(j) or j
                if self.kind(j) == "=":
                    i = self.skip_type(j + 1)
                    continue
            elif k == "import":
                self.read_import(i)
            elif k == "export":
                self.read_export(i)
            elif k in ("as",) or word == "satisfies":
                if self.kind(i + 1) not in ("const", ",", "}", ")", ";") and here["role"] != "names":
                    i = self.skip_type(i + 1)
                    continue
            elif k == "case" or k == "default" and self.kind(i + 1) == ":":
                here["case"] += 1
            elif k == "?":
                if self.kind(i + 1) not in (":", ")", ",", ";", "=", "("):
                    here["ternary"] += 1
                elif self.kind(i + 1) == "(" and not self.is_member_start(i - 1, here):
                    here["ternary"] += 1
            elif k == ":":
                if here["ternary"]:
                    here["ternary"] -= 1
                    self.colons[i] = "ternary"
                elif here["case"]:
                    here["case"] -= 1
                    self.colons[i] = "case"
                elif here["role"] == "object":
                    self.colons[i] = "property"
                elif here["role"] == "block" and self.kind(i - 1) == IDENTIFIER and self.kind(i - 2) in (";", "{", "}", "") and self.kind(i + 1) in ("for", "while", "do", "{"):
                    self.colons[i] = "label"
                else:
                    self.colons[i] = "type"
                    i = max(self.skip_type(i + 1), i + 1)
                    continue
            if k == "function":
                i = self.read_function(i)
                continue
            if here["role"] in ("class", "object") and self.is_member_start(i, here):
                j = self.read_method(i, here)
                if j is not None:
                    i = j
                    continue
            if k == "<" and self.kind(i - 1) in (IDENTIFIER, "=", "(", ",", "async"):
                j = self.skip_angles(i)
                if j is not None and self.kind(j) in ("(", "{", "implements", "extends", ")", LITERAL):
                    self.typed.update(range(i, j))
                    i = j
                    continue
            if k == "=>":
                self.add_arrow(i)
            if k in _CLOSE:
                role = "type" if here["role"] == "type" else self.role_of_brace(i, here["role"], header) if k == "{" else "group"
                header = "" if k == "{" else header
                if k == "{":
                    self.roles[i] = role
                if role == "type":
                    i = self.close(i) + 1
                    continue
                stack.append({"role": role, "ternary": 0, "case": 0, "at": i, "close": self.close(i)})
            elif k in (")", "]", "}") and len(stack) > 1:
                stack.pop()
            elif k == ";":
                here["ternary"] = here["case"] = 0
            i += 1

    def is_member_start(self, i: int, here: dict) -> bool:
        """Whether a member name may begin at ``i``: after a boundary and any modifiers."""
        j = i
        while j - 1 > here["at"] and (self.t[j - 1].text in ("public", "private", "protected", "static", "async", "abstract", "override", "readonly", "declare", "get", "set") or self.kind(j - 1) == "*"):
            j -= 1
        before = self.kind(j - 1)
        if j - 1 == here["at"]:
            return True
        if here["role"] == "object":
            return before == ","
        return here["role"] == "class" and (before in (";", "}", ")") or self.t[j].line > self.t[j - 1].end_line)

    def signature(self, i: int) -> tuple[int, int] | None:
        """For a parameter list that may start at ``i`` (with type parameters): (its bracket, the index after
        it and its return type)."""
        if self.kind(i) == "<":
            j = self.skip_angles(i)
            if j is None:
                return None
            self.typed.update(range(i, j))
            i = j
        if self.kind(i) != "(" or i not in self.src.partner:
            return None
        j = self.close(i) + 1
        if self.kind(j) == ":":
            j = self.skip_type(j + 1)
        return i, j

    def add(self, kind: str, name: str, origin: str, start: int, body: int, end: int) -> None:
        self.functions.append({"kind": kind, "name": name, "origin": origin, "start": start, "body": body, "end": end, "overloads": self.overloads.pop((self.scope(start), name), 0)})

    def scope(self, i: int) -> int:
        at, best = i, -1
        while at > 0:
            at -= 1
            if self.kind(at) == "}" and at in self.src.partner:
                at = self.src.partner[at]
            elif self.kind(at) == "{":
                best = at
                break
        return best

    def declared(self, start: int, name: str) -> None:
        self.signatures += 1
        key = (self.scope(start), name)
        self.overloads[key] = self.overloads.get(key, 0) + 1

    def read_function(self, i: int) -> int:
        j = i + 1 + (self.kind(i + 1) == "*")
        name = None
        if self.kind(j) not in ("(", "<"):
            name, j = self.t[j].text if j < self.n else None, j + 1
        found = self.signature(j)
        if found is None:
            return i + 1
        start = i - 1 if self.kind(i - 1) == "async" else i
        before = self.kind(start - 1)
        statement = before in ("", ";", "{", "}", ")", "export", "default", "else") or (before in (IDENTIFIER, LITERAL) and self.t[start].line > self.t[start - 1].end_line) or self.t[start - 1].text == "declare"
        if self.kind(found[1]) != "{":
            if name:
                self.declared(i, name)
            return found[0]
        kind = "function-declaration" if statement else "function-expression"
        label, origin = (name, "declared") if name else self.context_name(start)
        self.add(kind, label, origin, start, found[1], self.close(found[1]))
        return found[0]

    def read_method(self, i: int, here: dict) -> int | None:
        k = self.kind(i)
        if k == "[" and i in self.src.partner:
            name, after = None, self.close(i) + 1
        elif re.match(r"[\w$#\"']", self.t[i].text):
            name, after = self.t[i].text.strip("\"'"), i + 1
        else:
            return None
        if self.kind(after) in ("?", "!"):
            after += 1
        if self.kind(after) not in ("(", "<"):
            return None
        found = self.signature(after)
        if found is None:
            return None
        start = i
        accessor = "method"
        while start - 1 > here["at"] and (self.t[start - 1].text in ("public", "private", "protected", "static", "async", "abstract", "override", "readonly", "get", "set") or self.kind(start - 1) == "*"):
            start -= 1
            if self.t[start].text in ("get", "set"):
                accessor = f"{self.t[start].text}-accessor"
        label = name or "(anonymous)"
        if self.kind(found[1]) != "{":
            if here["role"] == "class":
                self.declared(start, label)
            return found[0] if here["role"] == "class" else None
        if here["role"] == "class" and name == "constructor":
            accessor = "constructor"
        self.add(accessor, label, "declared" if name else "anonymous", start, found[1], self.close(found[1]))
        return found[0]

    def context_name(self, start: int) -> tuple[str, str]:
        """The variable or property that a function at ``start`` is the value of."""
        if self.kind(start - 1) == ":" and self.colons.get(start - 1) == "property":
            return self.t[start - 2].text.strip("\"'"), "contextual"
        if self.kind(start - 1) == "=":
            j = start - 2
            while j in self.typed or (self.kind(j) == ":" and self.colons.get(j) == "type"):
                j -= 1
            if self.kind(j) == IDENTIFIER and self.kind(j - 1) in ("const", "let", "var", ","):
                return self.t[j].text, "contextual"
        return "(anonymous)", "anonymous"

    def add_arrow(self, i: int) -> None:
        start = i - 1
        while start in self.typed or self.colons.get(start) == "type":
            start -= 1
        if self.kind(start) == ")":
            start = self.src.partner.get(start, start)
            while start - 1 in self.typed:
                start -= 1
        if self.kind(start - 1) == "async":
            start -= 1
        body = i + 1
        end = self.close(body) if self.kind(body) == "{" else self.expression_end(body)
        name, origin = self.context_name(start)
        self.add("arrow-function", name, origin, start, body, end)

    def expression_end(self, i: int) -> int:
        """The last token of the expression that starts at ``i``."""
        joins = BRANCH_OPERATORS | {"+", "-", "*", "/", "%", "=", "=>", ".", "?", ":", "<", ">", "<=", ">=", "===", "!==", "==", "!=", "&", "|", "in", "instanceof", "as", "("}
        start = i
        while i < self.n:
            k = self.kind(i)
            if k in (",", ";", ")", "]", "}"):
                return i - 1
            if i > start and self.t[i].line > self.t[i - 1].end_line and k not in joins and self.kind(i - 1) not in joins | {"await", "new", "return", "!"}:
                return i - 1
            i = self.close(i) + 1 if k in _CLOSE else i + 1
        return self.n - 1

    # --- statements and measures

    def statement_end(self, i: int) -> int:
        """The last token of the statement that starts at ``i``."""
        k = self.kind(i)
        if k == "{":
            return self.close(i)
        if k in ("if", "for", "while", "switch", "with"):
            j = i + 1 + (self.kind(i + 1) == "await")
            end = self.statement_end(self.close(j) + 1)
            if k == "if" and self.kind(end + 1) == "else":
                return self.statement_end(end + 2)
            return end
        if k == "do":
            end = self.statement_end(i + 1)
            return self.close(end + 2) if self.kind(end + 1) == "while" else end
        if k == "try":
            end = self.close(i + 1)
            if self.kind(end + 1) == "catch":
                j = end + 2
                end = self.close(self.close(j) + 1 if self.kind(j) == "(" else j)
            return self.close(end + 2) if self.kind(end + 1) == "finally" else end
        while i < self.n and self.kind(i) != ";":
            if self.kind(i) in (")", "]", "}"):
                return i - 1
            i = self.close(i) + 1 if self.kind(i) in _CLOSE else i + 1
            if i < self.n and self.t[i].line > self.t[i - 1].end_line and self.kind(i) in ("else", "if", "for", "while", "return", "const", "let", "case", "}"):
                return i - 1
        return min(i, self.n - 1)

    def keyword(self, i: int) -> bool:
        """Whether the word at ``i`` is a statement word, not a member name."""
        return self.kind(i - 1) not in (".", "?.") and self.kind(i + 1) not in (":", ",", "=", "?") and i not in self.typed

    def decisions(self):
        do_tails = set()
        for i in range(self.n):
            k = self.kind(i)
            if k == "do" and self.keyword(i):
                do_tails.add(self.statement_end(i + 1) + 1)
        for i in range(self.n):
            k = self.kind(i)
            if i in self.typed:
                continue
            if k in BRANCH_OPERATORS or (k in BRANCH_WORDS and self.keyword(i) and i not in do_tails and not (k == "catch" and self.kind(i - 1) != "}")):
                yield i
            elif k == ":" and self.colons.get(i) == "ternary":
                yield i
        self.do_tails = do_tails

    def measured(self) -> list[dict]:
        """The functions in order of their start, with complexity, nesting, depth, parent and lines."""
        fns = sorted(self.functions, key=lambda f: (f["start"], -f["end"]))
        owner, open_fns, starts = [None] * self.n, [], {}
        for n, f in enumerate(fns):
            starts.setdefault(f["start"], []).append(n)
        for i in range(self.n):
            while open_fns and fns[open_fns[-1]]["end"] < i:
                open_fns.pop()
            for n in starts.get(i, ()):
                fns[n]["parent"] = open_fns[-1] if open_fns else None
                fns[n]["depth"] = len(open_fns)
                open_fns.append(n)
            owner[i] = open_fns[-1] if open_fns else None
        cc = [1] * len(fns)
        for i in self.decisions():
            if owner[i] is not None:
                cc[owner[i]] += 1
        deepest, active = [0] * len(fns), []
        for i in range(self.n):
            while active and active[-1][1] < i:
                active.pop()
            if self.kind(i) in NESTING_WORDS and self.keyword(i) and i not in self.do_tails and owner[i] is not None:
                active.append((owner[i], self.statement_end(i)))
                deepest[owner[i]] = max(deepest[owner[i]], sum(a[0] == owner[i] for a in active))
        code = self.src.code_lines
        for n, f in enumerate(fns):
            first, last = self.t[f["start"]].line, self.t[f["end"]].end_line
            f |= {"cc": cc[n], "nesting": deepest[n], "start_line": first, "end_line": last, "sloc": sum(x in code for x in range(first, last + 1))}
        return fns

    # --- imports

    def site(self, kind: str, type_only: bool, i: int | None, at: int) -> None:
        specifier = self.t[i].text[1:-1] if i is not None else None
        self.imports.append({"kind": kind, "type_only": type_only, "specifier": specifier, "line": self.t[at if i is None else i].line})

    def literal(self, i: int) -> bool:
        return self.kind(i) == LITERAL and self.t[i].text[0] in "\"'`" and "${" not in self.t[i].text

    def read_import(self, i: int) -> None:
        if self.kind(i + 1) == "(":
            typed = i in self.typed or self.kind(i - 1) in (":", "|", "&") and self.colons.get(i - 1) == "type"
            ok = self.literal(i + 2) and self.kind(i + 3) in (")", ",")
            if ok or not typed:
                self.site("import" if typed else "dynamic", typed, i + 2 if ok else None, i)
            return
        if self.kind(i + 1) == ".":
            return
        type_only = self.t[i + 1].text == "type" and self.kind(i + 2) not in ("from", ",", "=") if i + 1 < self.n else False
        j = i + 1
        while j < self.n and self.kind(j) != ";" and not (j > i + 1 and self.kind(j) in ("import", "export", "const")):
            if self.literal(j):
                self.site("import", type_only, j, i)
                return
            if self.t[j].text == "require" or self.kind(j) not in ("(", "{", ",", "*", "=", "from", "as", IDENTIFIER, "default", "}"):
                if self.t[j].text == "require" and self.literal(j + 2):
                    self.site("import", type_only, j + 2, i)
                return
            j = self.close(j) + 1 if self.kind(j) == "{" else j + 1

    def read_export(self, i: int) -> None:
        type_only = i + 1 < self.n and self.t[i + 1].text == "type"
        j = i + 1 + type_only
        if self.kind(j) == "{":
            j = self.close(j) + 1
        elif self.kind(j) == "*":
            j += 3 if self.kind(j + 1) == "as" else 1
        else:
            return
        if self.kind(j) == "from" and self.literal(j + 1):
            self.site("re-export", type_only, j + 1, i)


def analyse(text: str) -> dict:
    """Line counts, functions, imports, normalised tokens and problems of one text.

    A null text is empty.  A text that doesn't lex or balance still yields what could be read."""
    src = tokenize(text or "")
    reader = Reader(src)
    in_types = [i for i in range(src.tokens and len(src.tokens) or 0) if reader.kind(i) == "import" and i in reader.typed]
    for i in in_types:
        reader.read_import(i)
    functions = reader.measured()
    return {
        "total_lines": src.total_lines,
        "code_lines": sorted(src.code_lines),
        "comment_only": len(src.comment_lines - src.code_lines),
        "functions": functions,
        "signatures": reader.signatures,
        "imports": sorted(reader.imports, key=lambda s: s["line"]),
        "tokens": normalised(src),
        "problems": src.problems,
    }
