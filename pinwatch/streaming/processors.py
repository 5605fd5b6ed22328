"""State that built-in streaming operators cannot express, as Spark stateful processors.

State lives in the state store, keyed and partitioned by Spark. Rows of a key are handled in event
order inside a trigger; across triggers arrival decides. Times are microseconds since the epoch, which
input rows and state return alike. A missing time counts as before all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import Any

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What state holds for a missing time.
_NO_TIME = -(1 << 62)


def _moment(at: int | None) -> int:
    return _NO_TIME if at is None else at


def _time(at: int) -> int | None:
    return None if at == _NO_TIME else at


class FirstPerWindow(StatefulProcessor):
    """Accept a record, then drop its copies for a time counted from the accepted one. A record without a
    time can't be placed and passes. Input rows carry their time as an extra last column, which is not
    passed on."""

    def __init__(self, hours: int, expire: bool) -> None:
        self._window = hours * 3_600_000_000
        self._ttl = hours * 3_600_000 if expire else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._accepted = handle.getValueState("accepted", "at BIGINT", self._ttl)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = last = self._accepted.get()[0] if self._accepted.exists() else None
        placed = []
        for row in rows:
            if row[-1] is None:
                yield Row(*row.__fields__[:-1])(*row[:-1])
            else:
                placed.append(row)
        for row in sorted(placed, key=lambda r: (r[-1], r.event_id is not None, r.event_id or "")):
            if last is None or row[-1] >= last + self._window:
                last = row[-1]
                yield Row(*row.__fields__[:-1])(*row[:-1])
        if last != before:
            self._accepted.update((last,))

    def close(self) -> None:
        pass


# A service's spellings of one package are one entry of the state.
PIN_KEY = "service_id STRING, ecosystem STRING"
PIN_VALUE = (
    "spelled ARRAY<STRUCT<package: STRING, at: BIGINT, event_id: STRING, op_rank: INT, pos: INT, version: STRING, "
    "position: STRING, fresh: BOOLEAN, since: BIGINT>>"
)
CVE_KEY = "record STRING"
CVE_VALUE = (
    "at BIGINT, cve_id STRING, ecosystem STRING, low STRING, high STRING, ranged BOOLEAN, "
    "listed ARRAY<STRING>, special BOOLEAN, payload STRING"
)
CANDIDATE = (
    "cve_id STRING, service_id STRING, ecosystem STRING, package STRING, version STRING, "
    "detected_at BIGINT, since BIGINT, is_new_dependency BOOLEAN, special BOOLEAN, payload STRING"
)


class _Known:
    """The vulnerabilities of a key, and which of them affect each version that was asked for. Services
    are many and versions few, so a pin costs a look-up and not a pass over the vulnerabilities."""

    def __init__(self, records: dict[str, tuple], window: int | None) -> None:
        self.records = records
        self._window = window
        self._by_version: dict[tuple, list[tuple]] = {}

    def alive(self, cve: tuple, at: int) -> bool:
        return self._window is None or at < cve[0] + self._window

    def affecting(self, version: tuple, at: int) -> Iterator[tuple]:
        """What to report for a version at a time: of each vulnerability the earliest record that covers it,
        and every record that needs more than bounds, which is settled later."""
        found = self._by_version.get(version)
        if found is None:
            hits = sorted((value[0], record) for record, value in self.records.items() if _affects(value, version))
            found = self._by_version[version] = [self.records[record] for _, record in hits]
        seen: set[str] = set()
        for value in found:
            if not self.alive(value, at):
                continue
            if value[7]:
                yield value
            elif value[1] not in seen:
                seen.add(value[1])
                yield value

    def covers(self, cve: tuple, version: tuple) -> bool:
        """Whether a record other than ``cve`` already reports its vulnerability for the version."""
        return any(
            value is not cve and value[1] == cve[1] and not value[7] and self.alive(value, cve[0]) and _affects(value, version)
            for value in self.records.values()
        )

    def put(self, record: str, value: tuple) -> None:
        self.records[record] = value
        self._by_version.clear()


class PinsMeetVulnerabilities(StatefulProcessor):
    """Both sides kept in state: a new pin looks at known vulnerabilities, a new vulnerability at
    live pins. Versions arrive as sortable text, so a range test is two string comparisons, made once
    per version. Several records of one vulnerability report a pin's version once.

    Spellings of a package that a service holds at one time, in one version, are one pin: each says since
    when any of them has been there without a gap.

    With ``hours`` a vulnerability meets pins for so long from its own time on. Its entry goes when the
    watermark passes the end.

    What is held are the rows of the trigger, the vulnerabilities of the key, and its pins while
    there are at most ``held_pins``. Beyond that pins are read one by one, and streamed from the state
    when a vulnerability needs them all.
    """

    def __init__(self, held_pins: int = 20_000, hours: int | None = None) -> None:
        self._held_pins = held_pins
        self._window = None if hours is None else hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._pins = handle.getMapState("pins", PIN_KEY, PIN_VALUE)
        self._cves = handle.getMapState("cves", CVE_KEY, CVE_VALUE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        ordered = sorted(rows, key=lambda r: (_moment(r.at), r.is_cve, r.event_id or "", r.op_rank, r.pos))
        known = _Known({record[0]: tuple(value) for record, value in self._cves.iterator()}, self._window)
        touched: dict[tuple, dict[str, tuple]] = {}
        complete = True
        for pin, value in self._pins.iterator():
            if len(touched) == self._held_pins:
                touched, complete = {}, False
                break
            touched[tuple(pin)] = _spelled(value)
        unsaved: set[tuple] = set()
        for at, together in groupby(ordered, key=lambda r: _moment(r.at)):
            # A state replaced at the same time was never visible: only the last change counts.
            changed: dict[tuple, None] = {}
            news = []
            for row in together:
                if row.is_cve:
                    news.append(row)
                    continue
                pin = (row.service_id, row.ecosystem)
                if pin not in touched:
                    held = not complete and self._pins.containsKey(pin)
                    touched[pin] = _spelled(self._pins.getValue(pin)) if held else {}
                if _change(touched[pin], row, at):
                    changed[(pin, row.package)] = None
                    unsaved.add(pin)
            for pin, package in changed:
                spellings = touched[pin]
                value = spellings[package]
                if value[4] is None:
                    continue
                since = min([at, *[v[7] for name, v in spellings.items() if name != package and v[4] == value[4]]])
                value = spellings[package] = (*value[:7], since)
                for cve in known.affecting((pin[1], value[4], value[5]), at):
                    yield _match(cve, pin, package, value)
            for row in news:
                cve = self._learn(row, known)
                if cve is None:
                    continue
                if complete:
                    pins = touched.items()
                else:
                    self._save(touched, unsaved)
                    pins = ((tuple(pin), _spelled(value)) for pin, value in self._pins.iterator())
                wanted: dict[tuple, bool] = {}
                for pin, spellings in pins:
                    for package, value in spellings.items():
                        version = (pin[1], value[4], value[5])
                        if version not in wanted:
                            wanted[version] = _affects(cve, version) and (cve[7] or not known.covers(cve, version))
                        if wanted[version]:
                            yield _match(cve, pin, package, value)
        self._save(touched, unsaved)

    def _learn(self, row: Row, known: _Known) -> tuple | None:
        """Remember a vulnerability; the record if it is new or changed, None if it only repeats.
        A repeated record may bring a new payload, and was known since its first sight."""
        at = _moment(row.at)
        if self._window is not None and at == _NO_TIME:
            return None  # as old as can be
        tested = (row.cve_id, row.ecosystem, row.low, row.high, row.ranged, list(row.listed), row.special)
        before = known.records.get(row.record)
        repeated = before is not None and before[1:8] == tested and known.alive(before, at)
        cve = (before[0] if repeated else at, *tested, row.payload)
        if cve != before:
            known.put(row.record, cve)
            self._cves.updateValue((row.record,), cve)
            if self._window is not None and not repeated:
                self._handle.registerTimer(-(-(at + self._window) // 1000))
        return None if repeated else cve

    def _save(self, touched: dict[tuple, dict[str, tuple]], unsaved: set[tuple]) -> None:
        for pin in unsaved:
            self._pins.updateValue(pin, ([(name, *value) for name, value in touched[pin].items()],))
        unsaved.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        gone = [record[0] for record, value in self._cves.iterator() if value[0] + self._window <= now]
        for record in gone:
            self._cves.removeKey((record,))
        return iter(())

    def close(self) -> None:
        pass


def _spelled(value: Any) -> dict[str, tuple]:
    """Per spelling: time, event, rank, place, version, place in the version order, whether new, and since
    when the version has been there under any spelling."""
    return {entry[0]: tuple(entry[1:]) for entry in value[0]}


def _change(spellings: dict[str, tuple], row: Row, at: int) -> bool:
    """Whether an operation is newer than what is known of its pin, and then part of it."""
    order = (at, row.event_id or "", row.op_rank, row.pos)
    before = spellings.get(row.package)
    if before is not None and before[:4] > order:
        return False
    # Fresh: the package was absent before the event, whatever the event does step by step.
    same_event = before is not None and before[:2] == order[:2]
    fresh = before[6] if same_event else before is None or before[4] is None
    spellings[row.package] = (*order, row.version, row.position, fresh, at)
    return True


def _affects(cve: tuple, version: tuple) -> bool:
    """``version``: ecosystem, text, place in the version order."""
    _, _, ecosystem, low, high, ranged, listed, _, _ = cve
    of, text, position = version
    if text is None or (ecosystem and ecosystem != of):
        return False
    if text in listed:
        return True
    return ranged and position is not None and (low is None or low < position) and (high is None or position < high)


def _match(cve: tuple, pin: tuple, package: str, value: tuple) -> Row:
    return Row(
        cve_id=cve[1],
        service_id=pin[0],
        ecosystem=pin[1],
        package=package,
        version=value[4],
        detected_at=_time(max(cve[0], value[7])),
        since=value[7],
        is_new_dependency=value[6],
        special=cve[7],
        payload=cve[8],
    )


MATCH_KEY = "service_id STRING, ecosystem STRING, package_key STRING, version STRING, since BIGINT"
MATCH_VALUE = "package STRING, detected_at BIGINT, is_new_dependency BOOLEAN, matched_package STRING, own_score DOUBLE, own_tier STRING, changes INT"
SCORE_VALUE = "at BIGINT, event_id STRING, score DOUBLE, changes INT"
SCORED = (
    "cve_id STRING, service_id STRING, ecosystem STRING, package STRING, version STRING, detected_at BIGINT, "
    "is_new_dependency BOOLEAN, matched_package STRING, own_score DOUBLE, own_tier STRING, score DOUBLE, revision INT"
)


class MatchesMeetScores(StatefulProcessor):
    """Matches of a vulnerability and its newest score, whichever comes first. A score that changes sends
    all matches again, and a match that others merge into is sent again if that changes it; ``revision``
    grows from message to message of a match.

    Matches that differ in the spelling of the package, or that several records of the vulnerability
    report, are one: detected first, in the spelling that sorts first, and new if one of them is.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._score = handle.getValueState("score", SCORE_VALUE)
        self._matches = handle.getMapState("matches", MATCH_KEY, MATCH_VALUE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = tuple(self._score.get()) if self._score.exists() else (_NO_TIME, "", None, 0)
        newest, arrived = before, {}
        for row in rows:
            if row.is_score:
                seen = (_moment(row.at), row.event_id or "", row.score)
                if newest[2] is None or seen[:2] > newest[:2]:
                    newest = (*seen, before[3] + (seen[2] != before[2]))
            else:
                self._take(row, arrived)
        if newest != before:
            self._score.update(newest)
        for match, (value, old) in arrived.items():
            if value != old:
                value = (*value[:6], value[6] + 1)
                self._matches.updateValue(match, value)
                yield _scored(key, match, value, newest)
        if newest[2] != before[2]:
            for match, value in self._matches.iterator():
                match = tuple(match)
                if match not in arrived or arrived[match][0] == arrived[match][1]:
                    yield _scored(key, match, tuple(value), newest)

    def _take(self, row: Row, arrived: dict[tuple, tuple]) -> None:
        """Merge a match into what arrived in this trigger: its value, and what the state has of it."""
        match = (row.service_id, row.ecosystem, row.package_key, row.version, row.since)
        if match not in arrived:
            old = tuple(self._matches.getValue(match)) if self._matches.containsKey(match) else None
            arrived[match] = (old, old)
        value, old = arrived[match]
        detected = _moment(row.detected_at)
        own = (row.matched_package, row.own_score, row.own_tier)
        if value is None:
            value = (row.package, detected, row.is_new_dependency, *own, 0)
        else:
            if detected < value[1]:
                value = (value[0], detected, value[2], *own, value[6])
            value = (min(value[0], row.package), value[1], value[2] or row.is_new_dependency, *value[3:])
        arrived[match] = (value, old)

    def close(self) -> None:
        pass


def _scored(key: Any, match: tuple, value: tuple, score: tuple) -> Row:
    return Row(
        cve_id=key[0],
        service_id=match[0],
        ecosystem=match[1],
        package=value[0],
        version=match[3],
        detected_at=_time(value[1]),
        is_new_dependency=value[2],
        matched_package=value[3],
        own_score=value[4],
        own_tier=value[5],
        score=score[2],
        revision=score[3] + value[6],
    )


SNAPSHOT_KEY = "ecosystem STRING, package STRING"
SNAPSHOT_VALUE = "at BIGINT, event_id STRING, op_rank INT, pos INT, version STRING"
SNAPSHOT = "service_id STRING, trigger_event_id STRING, snapshot_at BIGINT, ecosystem STRING, dependencies MAP<STRING, STRING>"


class SnapshotPerEvent(StatefulProcessor):
    """The full state of a service after each of its events, one row per ecosystem that holds a package. Each
    pin is an entry of the state, so an event writes what it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._pins = handle.getMapState("pins", SNAPSHOT_KEY, SNAPSHOT_VALUE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        pins = {tuple(pin): tuple(value) for pin, value in self._pins.iterator()}
        unsaved = set()
        order = lambda r: (_moment(r.at), r.event_id or "")
        for (at, event_id), together in groupby(sorted(rows, key=order), key=order):
            for row in together:
                for change in row.changes:
                    pin, place = (row.ecosystem, change["package"]), (at, event_id, change["op_rank"], change["pos"])
                    if pin not in pins or pins[pin][:4] <= place:
                        pins[pin] = (*place, None if change["op"] == "removed" else change["version"])
                        unsaved.add(pin)
            held: dict[str, dict[str, str]] = {}
            for (ecosystem, package), value in sorted(pins.items()):
                if value[4] is not None:
                    held.setdefault(ecosystem, {})[package] = value[4]
            for ecosystem, dependencies in held.items():
                yield Row(service_id=key[0], trigger_event_id=event_id, snapshot_at=_time(at), ecosystem=ecosystem, dependencies=dependencies)
        for pin in unsaved:
            self._pins.updateValue(pin, pins[pin])

    def close(self) -> None:
        pass
