"""Flow sagas: ordered steps that wait for conditions on the events received, with branches and timeouts.

A flow is a Saga whose state is {step, events, entered, counts, short}: the current step, the window of received events, the place in
it where the step began, how many events of the step each of its requirements has had, and whether the window has lost events of
the step. Conditions hold by these counts, so the window limits what guards and commands can read, not what is counted. Of a
step's branches, the first in order of declaration whose condition holds is taken.

The window. The event that began the instance stays always. When a step is left, history events from before it stay, and all of its
own, for its commands to read; a step's own events are kept without a limit, or up to step_window of them (the newest, of the types that
the flow waits for), and then nothing from before them but the first event. A window is at most history + 2 * step_window + 1 long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from .saga import CancelTimer, Command, Saga, StartTimer, Timeout

END = "__end__"
HISTORY = 100


@dataclass(frozen=True)
class Needs:
    """count events of a type (that a predicate holds on) since the step began. A flow with a step_window needs names of predicates, to know counts again after a change of the program."""

    type: str
    count: int = 1
    predicate: Callable[[dict], bool] | None = None
    name: str | None = None

    def __post_init__(self):
        if self.count < 1:
            raise ValueError("one event at least")

    def counts(self, e: dict) -> bool:
        return e["type"] == self.type and (self.predicate is None or self.predicate(e))

    def met(self, counts: Iterator[int]) -> bool:
        """Whether the next count, that of this leaf, is enough."""
        return next(counts) >= self.count

    def leaves(self) -> list[Needs]:
        return [self]


@dataclass(frozen=True)
class AllOf:
    parts: tuple

    def met(self, counts: Iterator[int]) -> bool:
        return all([p.met(counts) for p in self.parts])  # every part takes its counts

    def leaves(self) -> list[Needs]:
        return [x for p in self.parts for x in p.leaves()]


@dataclass(frozen=True)
class AnyOf:
    parts: tuple

    def met(self, counts: Iterator[int]) -> bool:
        return any([p.met(counts) for p in self.parts])

    def leaves(self) -> list[Needs]:
        return [x for p in self.parts for x in p.leaves()]


def event(type: str, count: int = 1, predicate: Callable[[dict], bool] | None = None, name: str | None = None) -> Needs:
    return Needs(type, count, predicate, name)


def _flat(kind, parts: tuple) -> tuple:
    if not parts:
        raise ValueError("a combination has parts")
    return tuple(x for p in parts for x in (p.parts if isinstance(p, kind) else (p,)))


def all_of(*parts) -> AllOf:
    """Requirements of one type can't be in several parts: one event would count for each."""
    out = AllOf(_flat(AllOf, parts))
    seen: set = set()
    for p in out.parts:
        own = {(x.type, x.predicate) for x in p.leaves()}
        if seen & own:
            raise ValueError(f"required in several parts: {sorted(t for t, _ in seen & own)}")
        seen |= own
    return out


def any_of(*parts) -> AnyOf:
    return AnyOf(_flat(AnyOf, parts))


@dataclass(frozen=True)
class Branch:
    """when: what it waits for; guard(received) may refuse it; then: the next step's name, None for the one after, END for none."""

    when: object
    then: str | None = None
    commands: Callable[[Received], list] = lambda r: []
    guard: Callable[[Received], bool] = lambda r: True


@dataclass(frozen=True)
class Step:
    name: str
    branches: tuple[Branch, ...]
    timeout: float | None = None
    on_timeout: Branch | None = None


@dataclass(frozen=True)
class Received:
    """The window of events, oldest first."""

    events: list[dict] = field(default_factory=list)

    @property
    def initiating(self) -> dict:
        return self.events[0]

    def all(self, type: str) -> list[dict]:
        return [e for e in self.events if e["type"] == type]

    def first(self, type: str) -> dict | None:
        return next(iter(self.all(type)), None)

    def count(self, type: str) -> int:
        return len(self.all(type))

    def any(self, type: str) -> bool:
        return bool(self.all(type))

    def none(self, type: str) -> bool:
        return not self.any(type)


def _named(steps: list[Step]) -> None:
    """Refuses predicates without a name, and a name of two predicates."""
    for s in steps:
        known: dict[str, object] = {}
        for x in (x for b in s.branches for x in b.when.leaves() if x.predicate is not None):
            if x.name is None or known.setdefault(x.name, x.predicate) is not x.predicate:
                raise ValueError(f"step {s.name}: with a step window, each predicate has a name of its own")


def flow(name: str, starts_on: str, steps: list[Step], history: int = HISTORY, keep: tuple[str, ...] = ("type", "position"), step_window: int | None = None) -> Saga:
    """The saga of a flow. keep: what of each event stays in the window, beside its type."""
    if history < 0 or (step_window is not None and step_window < 1):
        raise ValueError("history isn't negative, a step's window has an event")
    if step_window is not None:
        _named(steps)
    if not steps or len({s.name for s in steps}) < len(steps):
        raise ValueError("a flow has steps of different names")
    order = {s.name: i for i, s in enumerate(steps)}
    for s in steps:
        for b in (*s.branches, *filter(None, [s.on_timeout])):
            if b.then not in (None, END) and b.then not in order:
                raise ValueError(f"no step {b.then}")

    def after(s: Step, b: Branch) -> str:
        if b.then is not None:
            return b.then
        i = order[s.name] + 1
        return steps[i].name if i < len(steps) else END

    def timer(s: str) -> str:
        return f"{name}.{s}"

    def taken(state: dict, given) -> tuple[Step, Branch] | None:
        if state["step"] == END:
            return None
        s = steps[order[state["step"]]]
        if isinstance(given, Timeout):
            return (s, s.on_timeout or Branch(None, END)) if given.name == timer(s.name) else None
        counts, received = iter(state["counts"]["n"]), Received(state["events"])
        met = [b.when.met(counts) for b in s.branches]
        return next(((s, b) for b, m in zip(s.branches, met, strict=True) if m and b.guard(received)), None)

    types = frozenset(x.type for s in steps for b in s.branches for x in b.when.leaves())

    def leaves(state: dict) -> list[Needs]:
        return [x for b in steps[order[state["step"]]].branches for x in b.when.leaves()]

    def declared(own: list[Needs]) -> list[list]:
        """What the counts were counted for."""
        return [[x.type, x.name] for x in own]

    def counted(state: dict, e: dict) -> dict:
        """The step's counts with a new event; those of a state that has none, or others than the step's, from its window."""
        if state["step"] == END:
            return {"of": [], "n": []}
        own, kept = leaves(state), state.get("counts")
        if kept is None or kept["of"] != declared(own):
            if state.get("short"):
                raise ValueError(f"step {state['step']} waits for something else than before, and events that it would count are gone")
            kept = {"n": [sum(x.counts(o) for o in state["events"][state["entered"] : -1]) for x in own]}
        return {"of": declared(own), "n": [n + x.counts(e) for n, x in zip(kept["n"], own, strict=True)]}

    def within_step(state: dict) -> None:
        """Drops the oldest events of the step beyond its window, and all before them."""
        mine = [i for i in range(state["entered"], len(state["events"])) if state["events"][i]["type"] in types]
        if step_window is not None and len(mine) > step_window:
            del state["events"][1 : mine[-step_window]]
            state |= {"entered": 1, "short": True}

    def evolve(state: dict, given) -> dict:
        state = {**state, "events": list(state["events"]), "moved": None}
        if isinstance(given, dict):
            state["events"].append({k: given.get(k) for k in dict.fromkeys(("type", *keep))})
            if len(state["events"]) == 1:
                return state | {"entered": 1}
            state["counts"] = counted(state, state["events"][-1])
            within_step(state)
        found = taken(state, given)
        if found:
            s, b = found
            del state["events"][1 : max(1, state["entered"] - history)]
            state |= {"step": after(s, b), "entered": len(state["events"]), "counts": None, "short": False, "moved": [s.name, s.branches.index(b) if b in s.branches else -1]}
        return state

    def react(state: dict, given) -> list:
        out: list = []
        if state["moved"]:
            s = steps[order[state["moved"][0]]]
            b = s.branches[state["moved"][1]] if state["moved"][1] >= 0 else s.on_timeout
            out += [Command(c) for c in (b.commands(Received(state["events"])) if b else [])]
            out.append(CancelTimer(timer(s.name)))
            out += entering(state)
        return out

    def entering(state: dict) -> list:
        if state["step"] == END:
            return []
        s = steps[order[state["step"]]]
        return [StartTimer(timer(s.name), s.timeout)] if s.timeout is not None else []

    return Saga(
        name,
        lambda: {"step": steps[0].name, "events": [], "entered": 0, "counts": None, "short": False, "moved": None},
        frozenset((starts_on,)),
        evolve,
        react,
        lambda state, e: entering(state),
        lambda state: state["step"] == END,
        types,
    )
