"""Validity of an event by its type: rules as data, turned into one boolean expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import variant as V
from .keys import PLAIN_NAME
from .numbers import finite, integral

#: The current schema version and those that are accepted (fixed values).
VERSION, ACCEPTED = 11, (9, 10, 11)
#: Event types and the schema version that introduced each (fixed values).
INTRODUCED = {
    "error": 1,
    "crash": 1,
    "performance-stall": 1,
    "operational-metrics": 5,
    "server-stall": 6,
    "workspace-names": 7,
    "workspace-shape": 8,
    "feature-usage": 9,
    "process-memory": 10,
}
RUNTIMES = ("main", "renderer", "server")
STALL_SOURCES = ("event-loop", "unresponsive")
#: Longest lists (fixed values).
MAX_OPERATIONS, MAX_CULPRITS, MAX_CHATS, MAX_FEATURES = 129, 65, 400, 64
ENVELOPE = ("schemaVersion", "type", "runtime", "timestamp", "appVersion", "platform")
WINDOW = ("windowStartedAt", "windowEndedAt")

Rule = Callable[[Column], Column]


def _bound(v: Column, names: tuple[str, ...]) -> Column:
    """What rules read: a VARIANT, and its members of these names, null if it is no object. A lambda binds it, so members are looked up once."""
    return F.struct(v.alias("v"), V.fields(v, names).alias("m"))


def _at(e: Column, name: str) -> Column:
    return e["m"][name]


def _of(name: str, test: Callable[[Column], Column]) -> Rule:
    return lambda e: test(_at(e, name))


def _object(e: Column) -> Column:
    return e["m"].isNotNull()


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _text(x: Column) -> Column:
    return V.is_text(x)


def _finite(x: Column) -> Column:
    return finite(V.number(x))


def _amount(x: Column) -> Column:
    return finite(V.number(x)) & (V.number(x) >= 0)


def _whole(x: Column) -> Column:
    return integral(V.number(x)) & (V.number(x) >= 0)


def _positive(x: Column) -> Column:
    return integral(V.number(x)) & (V.number(x) > 0)


def _name(x: Column) -> Column:
    return _yes(V.text(x).rlike(PLAIN_NAME))


def _optional(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: x.isNull() | test(x)


def _all(rules: list[Rule]) -> Rule:
    def test(e: Column) -> Column:
        out = F.lit(True)
        for r in rules:
            out = out & _yes(r(e))
        return out

    return test


def _only(names: tuple[str, ...]) -> Rule:
    return lambda e: F.size(F.array_except(V.members(e["v"]), F.array(*map(F.lit, names)))) == 0


def _rising(x: Column) -> Column:
    """A list of at least one boundary, all positive and finite, each above the one before."""
    values = F.transform(V.elements(x), V.number)
    steps = F.zip_with(values, F.concat(F.array(F.lit(0.0)), F.slice(values, 1, F.size(values) - 1)), lambda b, before: finite(b) & (b > before))
    return (F.size(values) > 0) & F.forall(steps, _yes)


def _counts(x: Column) -> Column:
    return V.is_array(x) & F.forall(V.elements(x), _whole)


def _list(name: str, most: int, test: Callable[[Column], Column], least: int = 0, names: tuple[str, ...] = ()) -> Rule:
    """A list whose elements pass a test, bound to their members of `names` if there are any."""

    def rule(e: Column) -> Column:
        x = V.elements(_at(e, name))
        items = F.transform(x, lambda i: _bound(i, names)) if names else x
        return (F.size(x) >= least) & (F.size(x) <= most) & F.forall(items, lambda i: _yes(test(i)))

    return rule


def _size(e: Column, name: str) -> Column:
    return F.size(V.elements(_at(e, name)))


def _runtime(which: str) -> Rule:
    return _of("runtime", lambda x: V.text(x) == which)


def _not_above(low: str, high: str) -> Rule:
    return lambda e: V.number(_at(e, low)) <= V.number(_at(e, high))


_window = [_of(n, _finite) for n in WINDOW]
_operation = _all([_object, _of("operation", _name), *[_of(n, _whole) for n in ("count", "okCount", "failCount")], *[_of(n, _amount) for n in ("min", "avg", "max")], _of("buckets", _counts)])
_culprit = _all([_object, _of("culprit", _name), _of("count", _whole), _of("totalOverlapMs", _amount)])
_feature = _all([_object, _only(("name", "count")), _of("name", _name), _of("count", _positive)])
#: Members that rules read of an operation, a culprit and a feature.
_OPERATION, _CULPRIT, _FEATURE = ("operation", "count", "okCount", "failCount", "min", "avg", "max", "buckets"), ("culprit", "count", "totalOverlapMs"), ("name", "count")
_shape = ("workspaces", "panesOpen", "panesActive", "chats", "peakPanesOpen", "peakChats")
_memory = ("samples", "rssMinBytes", "rssAvgBytes", "rssMaxBytes", "heapUsedMaxBytes", "processAgeMs")

RULES: dict[str, list[Rule]] = {
    "error": [_of("name", _text), _of("message", _text), _of("frames", V.is_array)],
    "crash": [_of("reason", _text)],
    # any number passes as a lag, an infinite one too
    "performance-stall": [_of("lagMs", V.is_number), _of("source", lambda x: V.text(x).isin(*STALL_SOURCES))],
    "operational-metrics": [
        *_window,
        _of("rejected", _whole),
        _of("rejectedStale", _optional(_whole)),
        _of("rejectedInvalid", _optional(_whole)),
        _of("boundaries", _rising),
        _list("operations", MAX_OPERATIONS, _operation, names=_OPERATION),
        lambda e: F.forall(V.elements(_at(e, "operations")), lambda o: F.size(V.elements(V.field(o, "buckets"))) == _size(e, "boundaries") + 1),
    ],
    "server-stall": [
        _runtime("server"),
        *_window,
        _of("count", _whole),
        _of("totalMs", _amount),
        _of("maxMs", _amount),
        _of("boundaries", _rising),
        _of("buckets", _counts),
        lambda e: _size(e, "buckets") == _size(e, "boundaries") + 1,
        _list("culprits", MAX_CULPRITS, _culprit, names=_CULPRIT),
    ],
    "workspace-names": [
        _runtime("server"),
        *_window,
        _list("chats", MAX_CHATS, _text),
        _of("chatCount", _whole),
        lambda e: V.number(_at(e, "chatCount")) >= _size(e, "chats"),
        _of("truncated", lambda x: V.boolean(x).isNotNull()),
    ],
    "workspace-shape": [
        _runtime("renderer"),
        _only((*ENVELOPE, *WINDOW, *_shape)),
        *_window,
        *[_of(n, _whole) for n in _shape],
        _not_above("panesOpen", "peakPanesOpen"),
        _not_above("chats", "peakChats"),
    ],
    "feature-usage": [
        _runtime("renderer"),
        _only((*ENVELOPE, *WINDOW, "features")),
        *_window,
        _list("features", MAX_FEATURES, _feature, least=1, names=_FEATURE),
        lambda e: F.size(F.array_distinct(F.transform(V.elements(_at(e, "features")), lambda f: V.text(V.field(f, "name"))))) == _size(e, "features"),
    ],
    "process-memory": [
        _only((*ENVELOPE, *WINDOW, *_memory)),
        *_window,
        _of("samples", _positive),
        *[_of(n, _whole) for n in ("rssMinBytes", "rssAvgBytes", "rssMaxBytes", "processAgeMs")],
        _of("heapUsedMaxBytes", _optional(_whole)),
        _not_above("rssMinBytes", "rssAvgBytes"),
        _not_above("rssAvgBytes", "rssMaxBytes"),
    ],
}


#: Members of an event that some rule reads.
_MEMBERS = tuple(dict.fromkeys((*ENVELOPE, *WINDOW, "chatName", "sessionName", "name", "message", "frames", "reason", "lagMs", "source", "rejected", "rejectedStale", "rejectedInvalid", "boundaries", "operations",
                                "count", "totalMs", "maxMs", "buckets", "culprits", "chats", "chatCount", "truncated", "features", *_shape, *_memory)))
_envelope = _all(
    [
        _object,
        _of("runtime", lambda x: V.text(x).isin(*RUNTIMES)),
        _of("timestamp", _finite),
        *[_of(n, _optional(_text)) for n in ("chatName", "sessionName", "appVersion", "platform")],
    ]
)


def _valid(e: Column, kind: Column, version: Column) -> Column:
    shape = None
    for name, rules in RULES.items():
        own = _all(rules)(e)
        shape = F.when(kind == name, own) if shape is None else shape.when(kind == name, own)
    return _envelope(e) & _yes(V.number(_at(e, "schemaVersion")) == version.cast("double")) & _yes(shape.otherwise(F.lit(False)))


def all_valid(events: Column, version: Column | None = None) -> Column:
    """True if each VARIANT of the array is a valid event of the version (default: the current one)."""
    version = F.lit(VERSION) if version is None else version
    bound = F.transform(events, lambda e: _bound(e, _MEMBERS))
    kinds = F.transform(bound, lambda e: F.struct(e.alias("e"), V.text(_at(e, "type")).alias("kind")))
    return F.forall(kinds, lambda x: _valid(x["e"], x["kind"], version))


def is_valid(event: Column, version: Column | None = None) -> Column:
    """True for a VARIANT that is a valid event of the version (default: the current one)."""
    return all_valid(F.array(event), version)
