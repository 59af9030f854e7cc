"""A working session: filters that stay, commands over a store and a manifest, evidence seen."""

from __future__ import annotations

import shlex
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.config import DEFAULT, EngineConfig
from lumensift.functions import cite
from lumensift.functions import text as X
from lumensift.operators import knn
from lumensift.plans import answers, find, provider, similar, tasks
from lumensift.sources import manifest


def parse_author(args: list[str]) -> tuple[list[str], str | None]:
    """Arguments without `--author NAME` (or --author=NAME), and the name."""
    rest, author, i = [], None, 0
    while i < len(args):
        if args[i] == "--author" and i + 1 < len(args):
            author, i = args[i + 1], i + 2
        elif args[i].startswith("--author="):
            author, i = args[i].split("=", 1)[1], i + 1
        else:
            rest.append(args[i])
            i += 1
    return rest, author


@dataclass
class Session:
    engine: tasks.Engine
    states: DataFrame
    filters: knn.Filters = field(default_factory=knn.Filters)
    seen: list[str] = field(default_factory=list)
    cfg: EngineConfig = DEFAULT

    def set(self, name: str, value: str) -> None:
        """source (a comma list of citation keys, taken as they are: show() tells what the manifest knows of each) or author."""
        if name == "author":
            self.filters = replace(self.filters, author=value)
        elif name in ("source", "sources"):
            keys = list(dict.fromkeys(knn.split_list(value)))
            self.filters = replace(self.filters, citation_key=",".join(keys))
        else:
            raise ValueError(f"unknown setting: {name}")

    def clear(self, name: str | None = None) -> None:
        self.filters = knn.Filters() if name is None else replace(self.filters, **{"author" if name == "author" else "citation_key": None})

    def show(self) -> DataFrame:
        """The session's sources and what the manifest knows of them."""
        keys = [(k,) for k in knn.split_list(self.filters.citation_key)]
        return manifest.key_status(self.engine.spark.createDataFrame(keys, "citation_key string"), self.states)

    def _vector(self, query: str) -> list[float]:
        if not query.strip():
            raise ValueError("an empty query")
        return self.engine.embed([query])[0]

    def _remember(self, rows: DataFrame) -> DataFrame:
        """The bounded result's citation keys, for completion."""
        self.seen = list(dict.fromkeys([*self.seen, *(r.citation_key for r in rows.select("citation_key").collect() if r.citation_key)]))
        return rows

    def search(self, query: str) -> DataFrame:
        """The best hits; session filters do not apply."""
        return self._remember(find.search(self.engine.store, self._vector(query), None, self.cfg.search_top_k, self.cfg))

    def find(self, query: str, author: str | None = None) -> DataFrame:
        """The best papers; of the filters only the author applies."""
        return find.find(self.engine.store, self._vector(query), knn.Filters(author=author or self.filters.author), self.cfg)

    def find_similar(self, key: str) -> similar.Similar:
        return similar.similar_papers(self.engine.store, key, self.cfg)

    def define(self, concept: str, author: str | None = None) -> DataFrame:
        return self.engine.define(concept, filters=replace(self.filters, author=author or self.filters.author))

    def explain(self, concept: str, author: str | None = None) -> answers.Answer:
        return self.engine.explain(concept, replace(self.filters, author=author or self.filters.author))

    def examples(self, concept: str) -> DataFrame:
        return self.engine.examples(concept, knn.Filters(citation_key=self.filters.citation_key))

    def summarise(self, key: str, item_type: str | None = None) -> answers.Answer:
        return self.engine.summarise(key, item_type)

    def evidence(self, chunk_id: str) -> DataFrame:
        return self.engine.store.filter(X.trim(self.engine.store.chunk_id) == chunk_id).drop("embedding")

    def open(self, chunk_id: str) -> str:
        """The deep link to the page a chunk begins on; an unknown chunk is an error."""
        row = self.evidence(chunk_id).select(cite.hit_link(F.col("attachment_key"), F.nullif("page_start", F.lit(0))).alias("link")).first()
        if row is None:
            raise ValueError(f"unknown chunk: {chunk_id}")
        return row.link

    def completions(self, prefix: str) -> list[str]:
        """Citation keys met in this session that begin so."""
        return sorted(k for k in self.seen if k.lower().startswith(prefix.lower()))

    def use_provider(self, name: str, **options) -> None:
        """Another model; what was retrieved stays."""
        self.engine.model = provider.create(name, **options)

    def run(self, line: str):
        """One typed command."""
        words = shlex.split(line)
        if not words:
            return None
        (name, *args), author = (words[:1] + parse_author(words[1:])[0]), parse_author(words[1:])[1]
        if name == "find" and args[:1] == ["similar"]:
            return self.find_similar(" ".join(a for a in args[1:] if a != "--debug"))
        text = " ".join(a for a in args if not a.startswith("--"))
        commands: dict[str, Callable] = {
            "search": lambda: self.search(text), "find": lambda: self.find(text, author), "define": lambda: self.define(text, author), "explain": lambda: self.explain(text, author),
            "examples": lambda: self.examples(text), "summarize": lambda: self.summarise(text), "summarise": lambda: self.summarise(text), "evidence": lambda: self.evidence(text), "open": lambda: self.open(text), "show": self.show,
            "set": lambda: self.set(args[0], " ".join(args[1:])), "clear": lambda: self.clear(args[0] if args else None),
        }
        if name not in commands:
            raise ValueError(f"unknown command: {name}")
        return commands[name]()
