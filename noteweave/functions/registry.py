"""Functions of one's own in expressions, and modules of them."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from types import ModuleType

from noteweave.functions.columns import COLUMNS
from noteweave.functions.interpreter import FUNCTIONS, OWN, VECTOR, EvaluationError, add_own
from noteweave.functions.literals import type_of


def register(name: str, value: Callable, *, column: Callable | None = None, over: dict[int, tuple[int, ...]] | None = None) -> None:
    """Make ``value`` callable as ``name``. ``column`` gives its form over ``Val``s, so that it runs inside Spark's
    plans; without it expressions that call it go through the interpreter. ``over``: positions, per number of
    arguments, that map over arrays."""
    key = name.lower()
    add_own({key: (value, over)})
    COLUMNS.pop(key, None)
    if column:
        COLUMNS[key] = column


def unregister(name: str) -> None:
    for table in (FUNCTIONS, COLUMNS, VECTOR, OWN):
        table.pop(name.lower(), None)


class Overloads:
    """A function of several forms, told apart by the number and kinds of its arguments.

    ``add`` takes the kinds (``type_of`` names, ``*`` for any) and the form; ``vararg`` one for any other arguments;
    ``vectorize`` the positions that map over arrays for a number of arguments. A null where no form
    takes one gives null; other arguments that no form takes are an error. ``build`` registers the function.
    """

    def __init__(self, name: str):
        self.name, self.forms, self.rest, self.over = name, [], None, {}

    def add(self, *kinds: str, form: Callable) -> Overloads:
        self.forms.append((kinds, form))
        return self

    def vararg(self, form: Callable) -> Overloads:
        self.rest = form
        return self

    def vectorize(self, arguments: int, *positions: int) -> Overloads:
        self.over[arguments] = positions
        return self

    def __call__(self, *args):
        kinds = [type_of(a) for a in args]
        for wanted, form in self.forms:
            if len(wanted) == len(kinds) and all(w in ("*", k) for w, k in zip(wanted, kinds)):
                return form(*args)
        if self.rest:
            return self.rest(*args)
        if "null" in kinds and any(len(wanted) == len(kinds) for wanted, _ in self.forms):
            return None
        raise EvaluationError(f"no {self.name} of {', '.join(kinds) or 'nothing'}")

    def build(self) -> Overloads:
        register(self.name, self, over=self.over or None)
        return self


class Modules:
    """Python modules whose ``FUNCTIONS`` (name to callable) are registered once; a module may ``require`` others,
    but none that is still being loaded."""

    def __init__(self) -> None:
        self.loaded: dict[str, ModuleType] = {}
        self._loading: list[str] = []

    def require(self, name: str) -> ModuleType:
        if name in self.loaded:
            return self.loaded[name]
        if name in self._loading:
            raise ImportError("modules require each other: " + " -> ".join([*self._loading, name]))
        self._loading.append(name)
        try:
            module = importlib.import_module(name)
            for other in getattr(module, "REQUIRES", ()):
                self.require(other)
            for key, f in getattr(module, "FUNCTIONS", {}).items():
                register(key, f)
            self.loaded[name] = module
            return module
        finally:
            self._loading.pop()
