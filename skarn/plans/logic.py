"""A Datalog-style logic layer: parsed clauses become joins over fact tables.

A predicate is a DataFrame of string columns ``a0..an``; a rule is a join of its
body atoms on their shared variables; queries run over the saturated relations,
which a semi-naive fixpoint computes (only new facts are joined in each round).
Terms are flat: function terms, disjunction and quantifiers are parsed as
formulas but not executed; ``not p(...)`` in a body is an anti join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut


#: The one argument of a stored fact that has none.
HOLDS = "true"
#: Rounds of a fixpoint after which a relation is written in one piece.
COMPACT = 16


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Func:
    name: str
    args: tuple


@dataclass(frozen=True)
class Atom:
    name: str
    args: tuple = ()
    negated: bool = False

    @property
    def is_ground(self) -> bool:
        return not variables(self.args)


@dataclass(frozen=True)
class Clause:
    head: Atom
    body: tuple[Atom, ...] = ()
    label: str = ""


@dataclass(frozen=True)
class Formula:
    """and, or, implies, not, forall, exists over formulas and atoms."""

    op: str
    parts: tuple
    bound: tuple[str, ...] = ()


def variables(args: tuple) -> list[str]:
    out: list[str] = []
    for a in args:
        out += [a.name] if isinstance(a, Var) else variables(a.args) if isinstance(a, Func) else []
    return list(dict.fromkeys(out))


# --- parser -----------------------------------------------------------------------

_TOKEN = re.compile(r"\s*(:-|->|<-|[(),.&|~]|\"[^\"]*\"|'[^']*'|\?\w+|[^\s(),.&|~]+(?:\.\d+)?)")


class Parser:
    """Recursive descent; input is never evaluated."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip().rstrip(".")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise ValueError(f"cannot read {text[at:]!r}")
            self.tokens.append(m[1])
            at = m.end()
            while at < len(text) and text[at].isspace():
                at += 1
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, expected: str | None = None) -> str:
        got = self.peek()
        if got is None or (expected and got != expected):
            raise ValueError(f"expected {expected or 'more'}, found {got}")
        self.at += 1
        return got

    def term(self):
        token = self.take()
        if token.startswith("?"):
            return Var(token[1:])
        if token[0] in "\"'":
            return token[1:-1]
        if self.peek() == "(":
            return Func(token, self.arguments())
        return constant(token)

    def arguments(self) -> tuple:
        self.take("(")
        out = []
        while self.peek() != ")":
            out.append(self.term())
            if self.peek() == ",":
                self.take(",")
        self.take(")")
        return tuple(out)

    def atom(self) -> Atom:
        negated = self.peek() in ("not", "~")
        if negated:
            self.take()
        name = self.take()
        return Atom(name, self.arguments() if self.peek() == "(" else (), negated)

    def clause(self) -> Clause:
        head, body = self.atom(), []
        if self.peek() == ":-":
            self.take()
            body.append(self.atom())
            while self.peek() == ",":
                self.take()
                body.append(self.atom())
        if self.peek() is not None:
            raise ValueError(f"unexpected {self.peek()}")
        return Clause(head, tuple(body))

    def formula(self):
        """Lowest first: implies, or, and, then not, quantifiers, brackets, atoms."""
        left = self._joined("|", "or", lambda: self._joined("&", "and", self._unary))
        if self.peek() == "->":
            self.take()
            return Formula("implies", (left, self.formula()))
        return left

    def _joined(self, sign: str, op: str, part):
        parts = [part()]
        while self.peek() == sign:
            self.take()
            parts.append(part())
        return parts[0] if len(parts) == 1 else Formula(op, tuple(parts))

    def _unary(self):
        token = self.peek()
        if token == "~":
            self.take()
            return Formula("not", (self._unary(),))
        if token in ("forall", "exists"):
            self.take()
            return Formula(token, (), ()) if self.peek() is None else Formula(token, (self._unary_after_bound(),), self._bound)
        if token == "(":
            self.take()
            inner = self.formula()
            self.take(")")
            return inner
        return self.atom()

    def _unary_after_bound(self):
        bound = [self.take().lstrip("?")]
        while (self.peek() or "").startswith("?"):
            bound.append(self.take()[1:])
        inner = self._unary()
        self._bound = tuple(bound)
        return inner


def constant(token: str):
    """Literals in order: int, float, else the string."""
    for kind in (int, float):
        try:
            return kind(token)
        except ValueError:
            pass
    return token


def parse_clause(text: str) -> Clause:
    return Parser(text).clause()


def parse_atom(text: str) -> Atom:
    return Parser(text).atom()


def parse_formula(text: str):
    parser = Parser(text)
    out = parser.formula()
    if parser.peek() is not None:
        raise ValueError(f"unexpected {parser.peek()}")
    return out


def horn(formula, label: str = "") -> Clause:
    """An implication from an atom, or a conjunction of atoms, to an atom."""
    if isinstance(formula, Atom):
        return Clause(formula, (), label)
    if isinstance(formula, Formula) and formula.op == "implies" and isinstance(formula.parts[1], Atom):
        left = formula.parts[0]
        body = left.parts if isinstance(left, Formula) and left.op == "and" else (left,)
        if all(isinstance(b, Atom) for b in body):
            return Clause(formula.parts[1], tuple(body), label)
    raise ValueError("only implications from atoms to an atom can be executed")


def unify(a, b, bound: dict | None = None) -> dict | None:
    """A substitution that makes two terms or atoms equal, or None; with occurs check."""
    bound = dict(bound or {})

    def walk(t):
        while isinstance(t, Var) and t.name in bound:
            t = bound[t.name]
        return t

    def occurs(name, t) -> bool:
        t = walk(t)
        return t == Var(name) or (isinstance(t, Func) and any(occurs(name, x) for x in t.args))

    work = [(a, b)]
    while work:
        x, y = (walk(t) for t in work.pop())
        if x == y:
            continue
        if isinstance(x, Var):
            if occurs(x.name, y):
                return None
            bound[x.name] = y
        elif isinstance(y, Var):
            work.append((y, x))
        elif isinstance(x, (Func, Atom)) and type(x) is type(y) and x.name == y.name and len(x.args) == len(y.args):
            work += zip(x.args, y.args, strict=True)
        else:
            return None
    return bound


# --- execution ----------------------------------------------------------------------


def _columns(arity: int) -> list[str]:
    return [f"a{i}" for i in range(arity)]


def match(relation: DataFrame, atom: Atom) -> DataFrame:
    """The bindings of an atom: constants filter, a repeated variable is an equality."""
    if any(isinstance(a, Func) for a in atom.args):
        raise NotImplementedError("function terms are parsed but not executed")
    if not atom.args:  # whether it holds: a row without columns, or none
        return relation.limit(1).select()
    first: dict[str, str] = {}
    out = relation
    for name, arg in zip(_columns(len(atom.args)), atom.args, strict=True):
        if isinstance(arg, Var):
            if arg.name in first:
                out = out.filter(F.col(first[arg.name]) == F.col(name))
            else:
                first[arg.name] = name
        else:
            out = out.filter(F.col(name) == str(arg))
    return out.select(*[F.col(c).alias(v) for v, c in first.items()])


def solve(body: list[tuple[Atom, DataFrame]]) -> DataFrame:
    """Positive atoms joined on shared variables, then negated ones as anti joins."""
    positive = [match(r, a) for a, r in body if not a.negated]

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        shared = [c for c in left.columns if c in right.columns]
        return left.join(right, shared) if shared else left.join(right, F.lit(True))

    out = reduce(join, positive)
    for a, r in body:
        if a.negated:
            seen = match(r, Atom(a.name, a.args))
            shared = [c for c in seen.columns if c in out.columns]
            out = out.join(seen, shared or F.lit(True), "left_anti")
    return out


def head_rows(bindings: DataFrame, head: Atom) -> DataFrame:
    if not head.args:
        return bindings.select(F.lit(HOLDS).alias("a0"))
    return bindings.select(*[(F.col(a.name) if isinstance(a, Var) else F.lit(str(a))).alias(c) for c, a in zip(_columns(len(head.args)), head.args, strict=True)])


def shown(item) -> str:
    """The text of a term, atom or clause, as the parser reads it."""
    if isinstance(item, Var):
        return f"?{item.name}"
    if isinstance(item, Clause):
        return shown(item.head) + (" :- " + ", ".join(map(shown, item.body)) if item.body else "")
    if isinstance(item, (Atom, Func)):
        text = f"{item.name}({', '.join(map(shown, item.args))})" if item.args else item.name
        return f"not {text}" if isinstance(item, Atom) and item.negated else text
    return str(item)


@dataclass
class LogicEngine:
    spark: SparkSession
    relations: dict[str, DataFrame] = field(default_factory=dict)
    rules: list[Clause] = field(default_factory=list)
    stated: list[Clause] = field(default_factory=list)

    # Facts and rules
    def load(self, name: str, facts: DataFrame) -> LogicEngine:
        """A fact table: its columns are the arguments, in order."""
        rows = facts.toDF(*_columns(len(facts.columns))).select(*[F.col(c).cast("string").alias(c) for c in _columns(len(facts.columns))])
        self.relations[name] = rows if name not in self.relations else self.relations[name].unionByName(rows)
        return self

    def tell(self, text: str) -> Clause:
        """A clause ``head :- body``, a fact, or a formula ``body -> head``."""
        clause = horn(parse_formula(text)) if "->" in text else parse_clause(text)
        if clause.body:
            self.rules.append(clause)
        elif clause.head.is_ground:
            self.stated.append(clause)
            self.load(clause.head.name, self.spark.createDataFrame([tuple(map(str, clause.head.args)) or (HOLDS,)]))
        else:
            raise ValueError("a fact must be ground")
        return clause

    def facts(self, predicate: str | None = None) -> list[Clause]:
        return [c for c in self.stated if predicate in (None, c.head.name)]

    def rules_of(self, predicate: str | None = None) -> list[Clause]:
        return [c for c in self.rules if predicate in (None, c.head.name)]

    def reset(self) -> None:
        self.relations.clear()
        self.rules.clear()
        self.stated.clear()

    def stats(self) -> dict:
        names = sorted(set(self.relations) | {r.head.name for r in self.rules})
        return {"facts": len(self.stated), "rules": len(self.rules), "total": len(self.stated) + len(self.rules), "predicates": names}

    # Inference
    def _relation(self, name: str, arity: int, relations: dict[str, DataFrame]) -> DataFrame:
        if name in relations and len(relations[name].columns) == max(1, arity):
            return relations[name]
        return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in _columns(arity) or ["a0"]))

    def _needed(self, goal: str) -> set[str]:
        """Predicates that can take part in a proof of ``goal``."""
        out, work = set(), [goal]
        while work:
            name = work.pop()
            if name not in out:
                out.add(name)
                work += [a.name for r in self.rules if r.head.name == name for a in r.body]
        return out

    def _strata(self, names: set[str]) -> list[list[Clause]]:
        """Rules in layers, so that what a rule negates is complete before it."""
        level = dict.fromkeys(names, 0)
        rules = [r for r in self.rules if r.head.name in names]
        for _ in range(len(names) + 1):
            changed = False
            for r in rules:
                want = max([level[r.head.name], *(level.get(a.name, 0) + a.negated for a in r.body)])
                if want > level[r.head.name]:
                    level[r.head.name], changed = want, True
            if not changed:
                return [[r for r in rules if level[r.head.name] == i] for i in range(max(level.values(), default=0) + 1)]
        raise ValueError("negation through recursion")

    def saturate(self, goal: str | None = None, max_rounds: int | None = None) -> dict[str, DataFrame]:
        """All relations that ``goal`` depends on (all, if none), at their fixpoint.

        A round writes only what is new; a relation is the union of what was written,
        put together again after every ``COMPACT`` rounds.  With ``max_rounds`` an
        unfinished fixpoint is an error.
        """
        names = self._needed(goal) if goal else set(self.relations) | {r.head.name for r in self.rules}
        relations = {n: r.distinct() for n, r in self.relations.items() if n in names}
        for rules in self._strata(names):
            heads = {r.head.name for r in rules}
            recursive = any(a.name in heads for r in rules for a in r.body)
            delta: dict[str, DataFrame] | None = None
            done = False
            for n in count(1) if max_rounds is None else range(1, max_rounds + 1):
                fresh: dict[str, DataFrame] = {}
                for r in rules:
                    spots = [None] if delta is None else [i for i, a in enumerate(r.body) if a.name in delta and not a.negated]
                    for spot in spots:
                        body = [(a, (delta[a.name] if i == spot else self._relation(a.name, len(a.args), relations))) for i, a in enumerate(r.body)]
                        rows = head_rows(solve(body), r.head)
                        fresh[r.head.name] = rows if r.head.name not in fresh else fresh[r.head.name].unionByName(rows)
                grown = {}
                for name, rows in fresh.items():
                    new = rows.distinct()
                    if name in relations:
                        new = new.join(relations[name], new.columns, "left_anti")
                    if recursive:
                        new = cut(new)
                        if new.isEmpty():
                            continue
                    grown[name] = new
                for name, new in grown.items():
                    relations[name] = new if name not in relations else relations[name].unionByName(new)
                    if recursive and n % COMPACT == 0:
                        relations[name] = cut(relations[name])
                delta = grown
                done = not recursive or not grown
                if done:
                    break
            if not done:
                raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
        return relations

    def ask(self, text: str, limit: int | None = 100, relations: dict[str, DataFrame] | None = None) -> DataFrame:
        """The distinct bindings of the query's variables."""
        atom = parse_atom(text)
        relation = self._relation(atom.name, len(atom.args), self.saturate(atom.name) if relations is None else relations)
        out = match(relation, atom).distinct()
        return out if limit is None else out.limit(limit)

    def proves(self, text: str, relations: dict[str, DataFrame] | None = None) -> bool:
        atom = parse_atom(text)
        relation = self._relation(atom.name, len(atom.args), self.saturate(atom.name) if relations is None else relations)
        for c, a in zip(_columns(len(atom.args)), atom.args, strict=True):
            relation = relation if isinstance(a, Var) else relation.filter(F.col(c) == str(a))
        return not relation.isEmpty()

    def forward(self) -> DataFrame:
        """(predicate, args) of the facts that the rules add."""
        done, out = self.saturate(), None
        for r in {r.head.name: r for r in self.rules}.values():
            if r.head.name not in done:
                continue
            new = done[r.head.name]
            if r.head.name in self.relations:
                new = new.join(self.relations[r.head.name].distinct(), new.columns, "left_anti")
            rows = new.select(F.lit(r.head.name).alias("predicate"), F.concat_ws(",", *new.columns).alias("args"))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], "predicate string, args string")

    def query(self, text: str, arities: dict[str, int] | None = None, limit: int = 100) -> dict:
        """The answer of the query route: proved, answers and arity warnings; the rules run once."""
        atom = parse_atom(text)
        relations = self.saturate(atom.name)
        rows = [r.asDict() for r in self.ask(text, limit, relations).collect()] if variables(atom.args) else []
        out = {"query": text, "proved": bool(rows) or self.proves(text, relations), "answers": rows, "answer_count": len(rows)}
        known = (arities or {}).get(atom.name)
        if known is not None and known != len(atom.args):
            out["warnings"] = [f"{atom.name} has arity {known}, not {len(atom.args)}"]
        return out


# --- ontology ---------------------------------------------------------------------


@dataclass
class Ontology:
    """predicates(name, arity, label), genls(sub, sup), types(ind, coll)."""

    predicates: DataFrame
    genls: DataFrame
    types: DataFrame

    def closure(self) -> DataFrame:
        """(sub, sup) of every ancestor, without the concept itself; cycles are safe.

        Path doubling: each round joins the closure with itself, so the number of
        rounds is the logarithm of the depth.
        """
        now = cut(self.genls.select("sub", "sup").distinct())
        size = now.count()
        while size:
            step = now.select(F.col("sub").alias("m"), F.col("sup").alias("top"))
            longer = now.join(step, now["sup"] == step["m"]).select("sub", F.col("top").alias("sup"))
            now = cut(now.unionByName(longer).distinct())
            grown = now.count()
            if grown == size:
                break
            size = grown
        return now.filter("sub <> sup")

    def all_types(self) -> DataFrame:
        """(ind, coll): direct types and their ancestors."""
        direct = self.types.select("ind", "coll")
        up = self.closure().select(F.col("sub").alias("coll"), F.col("sup"))
        return direct.unionByName(direct.join(up, "coll").select("ind", F.col("sup").alias("coll"))).distinct()

    def genls_goal(self, sub: str | None = None, sup: str | None = None) -> DataFrame:
        """Reflexive for a given concept; both free: the direct pairs."""
        if sub is None and sup is None:
            return self.genls.select("sub", "sup").distinct()
        out = self.closure()
        for name, value in (("sub", sub), ("sup", sup)):
            out = out if value is None else out.filter(F.col(name) == value)
        if sub is not None and sup is not None and sub != sup:
            return out
        own = sub if sub is not None else sup
        return out.unionByName(out.sparkSession.createDataFrame([(own, own)], "sub string, sup string")).distinct()

    def isa_goal(self, ind: str | None = None, coll: str | None = None) -> DataFrame:
        out = self.all_types()
        for name, value in (("ind", ind), ("coll", coll)):
            out = out if value is None else out.filter(F.col(name) == value)
        return out

    def check_arity(self, atoms: DataFrame) -> DataFrame:
        """atoms (name, n_args) with error: null, or what is wrong; unknown names pass."""
        joined = atoms.join(self.predicates.select("name", "arity"), "name", "left")
        wrong = F.concat_ws(" ", F.col("name"), F.lit("expects"), F.col("arity").cast("string"), F.lit("arguments, got"), F.col("n_args").cast("string"))
        return joined.select("name", "n_args", F.when(F.col("arity") != F.col("n_args"), wrong).alias("error"))

    def search(self, text: str, limit: int) -> DataFrame:
        return self.predicates.filter(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy("name").limit(limit)

    def stats(self) -> DataFrame:
        count = lambda df, c: df.agg(F.countDistinct(c).alias("n"))
        parts = [("predicates", count(self.predicates, "name")), ("concepts", count(self.genls, "sub")), ("individuals", count(self.types, "ind"))]
        return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("name"), "n") for n, df in parts])


def build_ontology(records: DataFrame, meta_types: list[str]) -> Ontology:
    """From records (about, types[], arity, label, genls[])."""
    predicates = records.filter(F.col("arity").isNotNull()).select(F.col("about").alias("name"), "arity", "label")
    parents = records.select(F.col("about").alias("sub"), F.explode(F.array_distinct("genls")).alias("sup")).filter("sub <> sup")
    kinds = F.array_except("types", F.array(*[F.lit(m) for m in meta_types]))
    types = records.select(F.col("about").alias("ind"), F.explode(kinds).alias("coll"))
    return Ontology(predicates, parents.distinct(), types.distinct())
