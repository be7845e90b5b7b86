"""parse_requests against a small Python model over generated request bodies."""

import json

from test_text import scan_tags

from hypothesis import given, settings
from hypothesis import strategies as st

from answer_eval.sources.requests import (
    ERR_CONFIG, ERR_ENTRY, ERR_MAX_EXAMPLES, ERR_NOT_OBJECT, MSG_NO_PARTICIPANTS, parse_requests,
)

scalar_text = st.sampled_from(["", "x", "http://a", "http://b/1", "0"])
endpoint = st.one_of(st.none(), scalar_text, st.sampled_from([0, 1, True, False]))
name = st.one_of(st.none(), st.sampled_from(["n1", "n2", ""]))


@st.composite
def list_entry(draw):
    e = {}
    for key, strat in (("name", name), ("agent_id", name), ("endpoint", endpoint)):
        if draw(st.booleans()):
            e[key] = draw(strat)
    return e


object_value = st.one_of(
    scalar_text,
    st.fixed_dictionaries({}, optional={"endpoint": st.one_of(st.none(), scalar_text),
                                        "agent_id": st.one_of(st.none(), scalar_text)}),
    st.sampled_from([7, None, [1], True]),
)
participants = st.one_of(
    st.lists(st.one_of(list_entry(), st.sampled_from([3, "s"])), max_size=4),
    st.dictionaries(st.sampled_from(["r1", "r2", "b", "a"]), object_value, max_size=4),
    st.sampled_from([None, "str", 5]),
)
config = st.one_of(st.just({}), st.fixed_dictionaries({"max_examples": st.one_of(st.none(), st.integers(0, 50), st.sampled_from(["", "4", 1.5]))}),
                   st.sampled_from([None, [], "x"]))


@st.composite
def json_body(draw):
    body = {}
    if draw(st.booleans()):
        body["participants"] = draw(participants)
    if draw(st.booleans()):
        body["config"] = draw(config)
    return json.dumps(body)


tag_body = st.builds(
    lambda url, n: "Evaluate\n" + (f"<white_agent_url>\n{url}\n</white_agent_url>\n" if url is not None else "")
    + (f"<max_examples>{n}</max_examples>" if n is not None else ""),
    st.one_of(st.none(), st.sampled_from(["", "http://t", " http://u "])),
    st.one_of(st.none(), st.sampled_from(["", "7", " 12 ", "ten"])),
)
two_values = st.builds(lambda a, sep, b: a + sep + b, json_body(), st.sampled_from([" ", ",", "\n"]), json_body())
body = st.one_of(json_body(), tag_body, two_values,
                 st.sampled_from(["[1, 2]", "5", '"s"', "plain text", "[1] [2]"]))


def _text(v):
    """How a JSON scalar reads back as text."""
    return v if isinstance(v, str) else json.dumps(v)


def model(text):
    """-> (participants, error): the request semantics, written independently."""
    try:
        data = json.loads(text)
    except json.JSONDecodeError:
        tags = scan_tags(text)
        n = tags.get("max_examples")
        if n:
            try:
                n = int(n)
            except ValueError:
                return [], ERR_MAX_EXAMPLES
        url = tags.get("white_agent_url")
        if url:
            return [(0, "agent", "agent", url, n or 0)], None
        return [], MSG_NO_PARTICIPANTS
    if not isinstance(data, dict):
        return [], ERR_NOT_OBJECT
    parts = data.get("participants")
    cfg = data.get("config", {})
    found = []
    if parts and isinstance(parts, list):
        if any(not isinstance(p, dict) for p in parts):
            return [], ERR_ENTRY
        for i, p in enumerate(parts):
            nm = p.get("name") if p.get("name") is not None else "unknown"
            aid = p.get("agent_id") if p.get("agent_id") is not None else nm
            if p.get("endpoint"):
                found.append((i, nm, aid, _text(p["endpoint"]), None))
    elif parts and isinstance(parts, dict):
        for i, role in enumerate(parts):
            v = parts[role]
            if isinstance(v, str):
                found.append((i, role, role, v, None))
            elif isinstance(v, dict):
                aid = v.get("agent_id") if v.get("agent_id") is not None else role
                found.append((i, role, aid, v.get("endpoint"), None))
    if not isinstance(cfg, dict):
        return [], ERR_CONFIG
    n = cfg.get("max_examples") or 0
    if not isinstance(n, int):
        return [], ERR_MAX_EXAMPLES
    if not found:
        return [], MSG_NO_PARTICIPANTS
    return [(i, nm, aid, ep, n) for i, nm, aid, ep, _ in found], None


@settings(max_examples=25, deadline=None)
@given(st.lists(body, min_size=1, max_size=25))
def test_parse_requests_matches_model(spark, bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string")
    parts, errors = parse_requests(df)
    got_p = sorted((r.request_id, r.position, r.name, r.agent_id, r.endpoint, r.max_examples)
                   for r in parts.collect())
    got_e = sorted((r.request_id, r.error) for r in errors.collect())
    want_p, want_e = [], []
    for rid, text in enumerate(bodies):
        found, err = model(text)
        want_p += [(rid, *f) for f in found]
        if err:
            want_e.append((rid, err))
    assert got_p == sorted(want_p)
    assert got_e == sorted(want_e)
