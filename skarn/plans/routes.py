"""The logic layer's routes in one process: a request in, a status and a JSON value out.

``LogicService.handle`` can be called directly; ``wsgi`` puts it behind any WSGI
server.  Answers are bounded by the request's own limits and by ``CAP``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import parse_qs, unquote

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .logic import Clause, LogicEngine, Ontology, parse_atom, parse_clause, shown

#: Rows of one answer, at most.
CAP = 500
DEFAULT_SOLUTIONS, DEFAULT_MATCHES = 100, 20


class Refused(Exception):
    def __init__(self, message: str, status: int = 400):
        super().__init__(message)
        self.status = status


class LogicService:
    """Facts, rules and queries beside an ontology."""

    def __init__(self, spark: SparkSession, ontology: Ontology | None = None):
        self.spark, self.engine = spark, LogicEngine(spark)
        empty = lambda schema: spark.createDataFrame([], schema)
        self.ontology = ontology or Ontology(empty("name string, arity int, label string"), empty("sub string, sup string"), empty("ind string, coll string"))
        self.routes: dict[tuple[str, str], Callable[[dict], dict]] = {
            ("POST", "/fact"): lambda q: self._tell(q, "fact"),
            ("POST", "/rule"): lambda q: self._tell(q, "rule"),
            ("POST", "/clause"): lambda q: self._tell(q, "clause"),
            ("POST", "/query"): self._query,
            ("POST", "/forward"): self._forward,
            ("GET", "/facts"): lambda q: self._listed("facts", [shown(c.head) for c in self.engine.facts(q.get("predicate"))]),
            ("GET", "/rules"): lambda q: self._listed("rules", [shown(c) for c in self.engine.rules_of(q.get("predicate"))]),
            ("GET", "/stats"): lambda q: self.engine.stats(),
            ("POST", "/reset"): self._reset,
            ("GET", "/ontology/stats"): lambda q: {r["name"]: r["n"] for r in self.ontology.stats().collect()},
            ("GET", "/ontology/search"): self._search,
            ("POST", "/ontology/genls"): self._genls,
            ("POST", "/ontology/isa"): self._isa,
            ("GET", "/health"): lambda q: {"status": "ok", "kb": self.engine.stats()},
        }

    def handle(self, method: str, path: str, values: dict | None = None) -> tuple[int, dict]:
        """200 and the answer, 400 for a request that makes no sense, 404 for what there is not."""
        prefix = "/ontology/predicate/"
        try:
            if method == "GET" and path.startswith(prefix):
                return 200, self._predicate(unquote(path[len(prefix) :]))
            if (method, path) not in self.routes:
                raise Refused(f"no route {method} {path}", 404)
            return 200, self.routes[method, path](values or {})
        except Refused as refused:
            return refused.status, {"error": str(refused)}

    def wsgi(self, environ: dict, start_response: Callable) -> list[bytes]:
        values = {k: v[-1] for k, v in parse_qs(environ.get("QUERY_STRING", "")).items()}
        body = environ["wsgi.input"].read(int(environ.get("CONTENT_LENGTH") or 0)) if "wsgi.input" in environ else b""
        status, answer = 400, {"error": "the body is no JSON object"}
        try:
            sent = json.loads(body) if body else {}
        except ValueError:
            sent = None
        if isinstance(sent, dict):
            status, answer = self.handle(environ["REQUEST_METHOD"], environ.get("PATH_INFO", "/"), {**values, **sent})
        start_response(f"{status} {'OK' if status == 200 else 'Error'}", [("Content-Type", "application/json")])
        return [json.dumps(answer, default=str).encode()]

    # Knowledge
    @staticmethod
    def _text(values: dict, name: str) -> str:
        text = str(values.get(name) or "").strip()
        if not text:
            raise Refused(f"'{name}' field required")
        return text

    @staticmethod
    def _number(values: dict, name: str, default: int) -> int:
        try:
            return int(values.get(name, default))
        except (TypeError, ValueError):
            raise Refused(f"'{name}' must be a number") from None

    def _parsed(self, parse: Callable, text: str):
        try:
            return parse(text)
        except (ValueError, IndexError, NotImplementedError) as wrong:
            raise Refused(f"Parse error: {wrong}") from None

    def _tell(self, values: dict, kind: str) -> dict:
        clause: Clause = self._parsed(parse_clause, self._text(values, kind))
        if kind == "fact" and clause.body:
            raise Refused("a fact has no body; use /rule")
        if kind == "rule" and not clause.body:
            raise Refused("a rule has a body; use /fact")
        text = shown(clause) if clause.body else shown(clause.head)
        self._parsed(self.engine.tell, text)
        return {"status": f"{'rule' if clause.body else 'fact'} added", kind: text}

    def _query(self, values: dict) -> dict:
        atom = self._parsed(parse_atom, self._text(values, "query"))
        limit = min(CAP, self._number(values, "max_solutions", DEFAULT_SOLUTIONS))
        known = {r["name"]: r["arity"] for r in self.ontology.predicates.filter(F.col("name") == atom.name).collect()}  # a row or none
        return self._parsed(lambda text: self.engine.query(text, known, limit), shown(atom))

    def _forward(self, values: dict) -> dict:
        added = self._parsed(lambda _: self.engine.forward().count(), "")
        return {"status": "forward chaining complete", "new_facts_derived": added, "kb_stats": self.engine.stats()}

    @staticmethod
    def _listed(name: str, rows: list) -> dict:
        return {name: rows, "count": len(rows)}

    def _reset(self, values: dict) -> dict:
        self.engine.reset()
        return {"status": "kb reset"}

    # Ontology
    def _predicate(self, name: str) -> dict:
        found = self.ontology.predicates.filter(F.col("name") == name).first()
        if found is None:
            raise Refused(f"Predicate '{name}' not found", 404)
        return found.asDict()

    def _search(self, values: dict) -> dict:
        text = self._text(values, "q")
        rows = [r.asDict() for r in self.ontology.search(text, min(CAP, self._number(values, "limit", DEFAULT_MATCHES))).collect()]
        return {"query": text, "results": rows, "count": len(rows)}

    def _names(self, rows, column: str) -> list[str]:
        return [r[0] for r in rows.select(column).distinct().orderBy(column).limit(CAP).collect()]

    def _genls(self, values: dict) -> dict:
        concept, above = values.get("concept"), values.get("superclass")
        if concept is not None:
            direct = values.get("depth") in (1, "1")
            pairs = self.ontology.genls if direct else self.ontology.closure()
            found = self._names(pairs.filter(F.col("sub") == str(concept)), "sup")
            return {"concept": concept, "superclasses": found, "count": len(found)}
        if above is None:
            raise Refused("Provide 'concept' or 'superclass'")
        known = self.ontology.genls.select("sub").distinct()
        found = self._names(self.ontology.genls_goal(sup=str(above)).join(known, "sub", "left_semi"), "sub")
        return {"superclass": above, "subclasses": found, "count": len(found)}

    def _isa(self, values: dict) -> dict:
        ind, coll = values.get("individual"), values.get("collection")
        if not ind and not coll:
            raise Refused("Provide 'individual' and/or 'collection'")
        rows = self.ontology.isa_goal(str(ind) if ind else None, str(coll) if coll else None)
        if ind and coll:
            return {"individual": ind, "collection": coll, "result": not rows.isEmpty()}
        if ind:
            direct = self._names(self.ontology.types.filter(F.col("ind") == str(ind)), "coll")
            return {"individual": ind, "direct_types": direct, "all_types": self._names(rows, "coll")}
        found = self._names(rows, "ind")
        return {"collection": coll, "instances": found, "count": len(found)}
