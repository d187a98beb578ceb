"""Flow rules written down plainly, from lists of all messages: what the operators are checked against.

For each handshake the applied messages are listed by rule, (phase, number) by (phase, number). Counts, the point of
completion, the latest transmissions and acks are then read off that list.
"""

from collections import namedtuple

Handshake = namedtuple("Handshake", "data_pipe ack_pipe req rem")


class Summary:
    """What one flow comes to."""

    def __init__(self, handshake, applied):
        self.data_pipe, self.ack_pipe = handshake.data_pipe, handshake.ack_pipe
        self.req_ms, self.rem_ms = handshake.req["first_ms"], handshake.rem["first_ms"]
        steps = progress(applied)
        data_at = next((n for n, (sent, _, expected) in enumerate(steps) if sent >= expected), None)
        ack_at = next((n for n, (_, acked, expected) in enumerate(steps) if acked >= expected), None)
        self.data_done, self.ack_done = data_at is not None, ack_at is not None
        if self.data_done and self.ack_done:
            closed = max(data_at, ack_at)
            applied = [x for n, x in enumerate(applied) if n <= closed or (n - closed) % 2 == 0]
            steps = progress(applied)
        self.sent, self.acked, self.expected = steps[-1]
        on_data = [m for side, m in applied if side == "data"]
        self.start, self.end = min(m["first_ms"] for m in on_data), max(m["last_ms"] for m in on_data)
        self.payload = sum(m["payload_bytes"] for m in on_data if m["kind"] == "data")
        self.table = blocks(applied)


def entries(applied):
    """(place, "tx" or "ack", block number, message) of every number that the applied messages list."""
    found = []
    for n, (side, m) in enumerate(applied):
        listed = m["seqs"] if (side, m["kind"]) == ("data", "data") else m["acks"] if (side, m["kind"]) == ("ack", "ack") else []
        found += [((n, i), "tx" if side == "data" else "ack", number, m) for i, number in enumerate(listed)]
    return found


def progress(applied):
    """(blocks sent, first acks, blocks expected) after each applied message.

    An ack is a first one if what comes before it, of all that names its number, is a transmission.
    """
    found = entries(applied)
    latest, fresh = {}, set()
    for place, what, number, _ in found:
        if what == "ack" and latest.get(number) == "tx":
            fresh.add(place)
        latest[number] = what
    result = []
    for n in range(len(applied)):
        so_far = [x for x in found if x[0][0] <= n]
        numbers = [number for _, what, number, _ in so_far if what == "tx"]
        acks = sum(place in fresh for place, *_ in so_far)
        result.append((len(numbers), acks, max([3, *(number + 2 for number in numbers)])))
    return result


def blocks(applied):
    """{block number: [time sent, time acked]}: the flow's latest data-side time at the last transmission, the last ack after."""
    found, result = entries(applied), {}
    for number in {number for _, what, number, _ in found if what == "tx"}:
        sent = max(place for place, what, other, _ in found if (what, other) == ("tx", number))
        times = [m["last_ms"] for side, m in applied[: sent[0] + 1] if side == "data"]
        acks = [(place, m["last_ms"]) for place, what, other, m in found if (what, other) == ("ack", number) and place > sent]
        result[number] = [max(times), max(acks)[1] if acks else None]
    return result


def pair_up(messages):
    """The handshakes: a response with the request right before it, of all calls on its ack pipe."""
    calls = {}
    for m in messages:
        if m["kind"] == "req":
            calls.setdefault(m["adv_pipe_id"], []).append(m)
        elif m["kind"] == "rem" and m["adv_pipe_id"] is not None:
            calls.setdefault(m["pipe_id"], []).append(m)
    found = []
    for ack_pipe, line in calls.items():
        for before, m in zip(line, line[1:], strict=False):
            if m["kind"] == "rem" and before["kind"] == "req":
                found.append(Handshake(m["adv_pipe_id"], ack_pipe, before, m))
    return sorted(found, key=lambda h: h.rem["msg_no"])


def route(m, handshakes):
    """(side, handshake) of a message: the latest handshake before it, on its data pipe or else its ack pipe."""
    earlier = [h for h in handshakes if h.rem["msg_no"] < m["msg_no"]]
    for side, kinds in (("data", ("data", "close")), ("ack", ("ack", "close"))):
        mine = [h for h in earlier if getattr(h, f"{side}_pipe") == m["pipe_id"]]
        if m["kind"] in kinds and mine:
            return side, mine[-1]
    return None, None


def replay(messages, every=False):
    """``(flows by data pipe, matched handshakes, unanswered request numbers)`` of one trace in order.

    With ``every``, each handshake is a flow, by data pipe and number of the response.
    """
    handshakes = pair_up(messages)
    moved = [(m, *route(m, handshakes)) for m in messages if m["kind"] in ("data", "ack", "close")]
    flows = {}
    for h in handshakes:  # the last one on a data pipe is the one that counts, unless every one does
        waited = [m for m, side, _ in moved if side is None and m["msg_no"] < h.rem["msg_no"]]
        applied = [("data", h.req), ("ack", h.rem)]
        applied += [("data", m) for m in waited if m["pipe_id"] == h.data_pipe]
        applied += [("ack", m) for m in waited if m["pipe_id"] == h.ack_pipe]
        applied += [(side, m) for m, side, to in moved if to is h]
        flows[(h.data_pipe, h.rem["msg_no"]) if every else h.data_pipe] = (h, applied)
    taken = {h.req["msg_no"] for h in handshakes}
    unanswered = sorted(m["msg_no"] for m in messages if m["kind"] == "req" and m["msg_no"] not in taken)
    matched = [(h.data_pipe, h.ack_pipe, h.req["msg_no"], h.rem["msg_no"]) for h in handshakes]
    return {pipe: Summary(h, applied) for pipe, (h, applied) in flows.items()}, matched, unanswered
