"""Evaluation requests (S4-S7, F1, U2): a table of request bodies -> participant
rows plus error rows.

A body is JSON (participants as a list or as an object keyed by role, and
``config.max_examples``) or, only when it is not JSON, text with
``<white_agent_url>`` / ``<max_examples>`` tags.  Parsing is per row with
VARIANT functions (``try_parse_json``, ``try_variant_get``) and the tag parser; the
three branches are disjoint (a body is JSON or it is not).  A request the evaluator would
reject (non-object JSON, a non-object participant entry, a non-object config, a
non-integer tag value) or that names no participant becomes an error row; it
never fails the job.

Limits: a missing or falsy one (null, 0, "", false, [], {}) means all examples, a JSON
integer is taken, anything else is an error row.  ``position`` is the place of the
entry in the request, for both JSON forms.

Known differences from Python: NaN/Infinity literals are not JSON here; the tag-form
limit accepts ASCII digits only (Python's ``int`` also reads other Unicode digits).  Text after a complete JSON
value makes the body non-JSON, as in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answer_eval.functions.text import parse_tags as X_tags
from answer_eval.session import ensure_checkpoint_dir, spread

# The tag names of the text form and the no-participant message.
URL_TAG = "white_agent_url"
MAX_EXAMPLES_TAG = "max_examples"
TAG_PARTICIPANT = "agent"
MSG_NO_PARTICIPANTS = "ERROR: No participants found in request (tried JSON and tags)"
DEFAULT_NAME = "unknown"


# Our wording for requests the evaluator would have failed on.
ERR_NOT_OBJECT = "ERROR: request JSON is not an object"
ERR_ENTRY = "ERROR: a participant entry is not an object"
ERR_CONFIG = "ERROR: config is not an object"
ERR_MAX_EXAMPLES = "ERROR: max_examples is not an integer"


# A JSON value's kind is read from the first character of its canonical JSON
# text (one serialisation per value, cheap for request-sized values).
_ZERO_NUMBER = r"^-?0+(\.0*)?([eE][+-]?[0-9]+)?$"


def _json_text(v: Column) -> Column:
    return F.to_json(v)


def _truthy_text(j: Column) -> Column:
    """Python truthiness of a JSON value from its canonical JSON text (NULL =
    missing): null, "", false, 0, [], {} are falsy."""
    return (j.isNotNull() & ~j.isin("null", '""', "false", "[]", "{}")
            & ~j.rlike(_ZERO_NUMBER))


def _is_object_text(j: Column) -> Column:
    return j.startswith("{")


def _get(v: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def _py_int(text: Column) -> Column:
    """Python ``int(text)`` for ASCII digits: sign, surrounding whitespace and
    single underscores between digit groups (``1_0`` -> 10); NULL when invalid."""
    t = F.trim(text)
    ok = t.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$")
    return F.when(ok, F.regexp_replace(t, "_", "").try_cast("bigint"))


def _whole_json(body: Column) -> Column:
    """The body's JSON value, or NULL when the body is anything but one JSON value.

    ``try_parse_json`` also accepts a value with text behind it, so the body is parsed as
    the first element of an array that a mark closes, the mark being a digest of the
    body: only a whole value leaves exactly the two of them."""
    mark = F.md5(body)
    both = F.try_parse_json(F.concat(F.lit("["), body, F.lit(',"'), mark, F.lit('"]')))
    return F.struct(both.alias("both"), mark.alias("mark"))


def parse_requests(requests: DataFrame, body_col: str = "body",
                   id_col: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """-> (participants, errors).

    participants: request_id, position, name, agent_id, endpoint, max_examples
      (0 = no limit, as a missing or zero limit both mean "all examples").
      list form: name default ``unknown``, agent_id default name, entries with a
      falsy endpoint dropped (F1); object form: ``role: "url"`` -> name = agent_id
      = role; ``role: {...}`` -> agent_id default role, endpoint may be NULL and is
      kept; other values dropped; tag form: one participant ``agent``.
    errors: request_id, error -- one row per rejected or empty request (S7).

    Requests are parsed once and the result is checkpointed: both outputs read it.  A table of few splits is
    spread over all cores first, since the work is in the parsing, not in the bytes.  Per request: parse once, read the kinds of the
    participants and config values, and (only for non-JSON bodies) scan the tags
    once; the candidate entries of the one branch that applies (U2: branches are
    disjoint) are exploded, and each entry is resolved by per-row expressions.
    """
    # Staged projections: every expensive expression (JSON parse, serialisation,
    # tag scan, higher-order function) appears exactly once; later stages read it
    # by name (these projections run interpreted, without subexpression sharing).
    c = F.col
    ensure_checkpoint_dir(requests.sparkSession)
    st = spread(requests.select(c(id_col).alias("request_id"), c(body_col).alias("_body")))
    st = st.select("request_id", "_body", _whole_json(c("_body")).alias("_w"))
    st = st.select("request_id", "_body", F.try_variant_get(c("_w.both"), "$", "array<variant>").alias("_a"),
                   c("_w.mark").alias("_mark"))
    whole = (F.size("_a") == 2) & F.coalesce(
        F.try_variant_get(F.get(c("_a"), F.lit(1)), "$", "string") == c("_mark"), F.lit(False))
    st = st.select("request_id", "_body", F.when(whole, F.get(c("_a"), F.lit(0))).alias("_v"),
                   F.coalesce(whole, F.lit(False)).alias("_json"))
    st = st.select(
        "request_id", "_v", "_json",
        _json_text(_get(c("_v"), "participants", "variant")).alias("_pj"),
        _json_text(_get(c("_v"), "config", "variant")).alias("_cj"),
        # one value and nothing else, so its first non-blank character is the kind
        F.when(c("_json"), F.ltrim(c("_body"), F.lit(" \t\r\n")).substr(1, 1)).alias("_vk"),
        X_tags(F.when(~c("_json"), c("_body"))).alias("_tags"),
        # keys in the order of the text (a variant sorts them)
        F.when(c("_json"), F.json_object_keys(F.get_json_object(c("_body"), "$.participants"))).alias("_keys"),
        F.when(c("_json"), F.try_variant_get(c("_v"), "$.config.max_examples", "variant")).alias("_limit"),
    )
    st = st.select("*", _json_text(c("_limit")).alias("_lj"),
                   F.when(F.schema_of_variant(c("_limit")) == "BIGINT",
                          F.try_variant_get(c("_limit"), "$", "bigint")).alias("_jmax"))
    st = st.select(
        "request_id", "_v", "_json", "_cj", "_vk", "_jmax", "_keys",
        (_truthy_text(c("_lj")) & c("_jmax").isNull()).alias("_bad_limit"),
        (c("_json") & _truthy_text(c("_pj")) & c("_pj").startswith("[")).alias("_use_list"),
        (c("_json") & _truthy_text(c("_pj")) & c("_pj").startswith("{")).alias("_use_obj"),
        F.element_at(c("_tags"), F.lit(URL_TAG)).alias("_url"),
        F.element_at(c("_tags"), F.lit(MAX_EXAMPLES_TAG)).alias("_n_text"),
    )
    # candidate entries carry their JSON text (ej) and, for list entries, the JSON
    # text of their endpoint (epj): each is serialised once, here.
    cand_type = "array<struct<pos:int,role:string,e:variant,url:string,ej:string,epj:string>>"
    no_text = F.lit(None).cast("string")

    def cand(i, role, e, url, with_endpoint):
        epj = _json_text(F.try_variant_get(e, "$.endpoint", "variant")) if with_endpoint else no_text
        return F.struct(i.alias("pos"), role.alias("role"), e.alias("e"), url.alias("url"),
                        _json_text(e).alias("ej"), epj.alias("epj"))

    def place(role, i):                      # of a key in the request's text
        return F.coalesce(F.nullif(F.array_position("_keys", role).cast("int"), F.lit(0)) - 1, i)

    from_list = F.transform(F.try_variant_get(c("_v"), "$.participants", "array<variant>"),
                            lambda e, i: cand(i, no_text, e, no_text, True))
    from_obj = F.transform(F.map_entries(F.try_variant_get(c("_v"), "$.participants", "map<string,variant>")),
                           lambda kv, i: cand(place(kv["key"], i), kv["key"], kv["value"], no_text, False))
    url_ok = c("_url").isNotNull() & (c("_url") != F.lit(""))
    from_tags = F.array(F.struct(F.lit(0).alias("pos"), no_text.alias("role"),
                                 F.lit(None).cast("variant").alias("e"), c("_url").alias("url"),
                                 no_text.alias("ej"), no_text.alias("epj")))
    st = st.select(
        "request_id", "_json", "_cj", "_vk", "_jmax", "_bad_limit", "_use_list", "_n_text",
        F.when(c("_use_list"), from_list).when(c("_use_obj"), from_obj)
         .when(~c("_json") & url_ok, from_tags).otherwise(F.array().cast(cand_type)).alias("_raw"),
        _py_int(c("_n_text")).alias("_n_val"),
    )

    def keep(x: Column) -> Column:  # a candidate entry that yields a participant
        ej = x["ej"]
        return (x["url"].isNotNull()
                | (x["role"].isNull() & _truthy_text(x["epj"]))                   # F1
                | (x["role"].isNotNull() & (ej.startswith('"') | ej.startswith("{"))))

    st = st.select(
        "request_id", "_json", "_cj", "_vk", "_jmax", "_bad_limit", "_use_list", "_n_text", "_n_val",
        F.exists(c("_raw"), lambda x: x["url"].isNull() & ~_is_object_text(x["ej"])).alias("_bad"),
        F.filter(c("_raw"), keep).alias("_cands"),
    )
    st = st.select(
        "request_id", "_cands",
        F.when(c("_json"), (
            F.when(c("_vk") != F.lit("{"), F.lit(ERR_NOT_OBJECT))
            .when(c("_use_list") & c("_bad"), F.lit(ERR_ENTRY))
            .when(c("_cj").isNotNull() & ~_is_object_text(c("_cj")), F.lit(ERR_CONFIG))
            .when(c("_bad_limit"), F.lit(ERR_MAX_EXAMPLES))
        )).otherwise(F.when(c("_n_text").isNotNull() & (c("_n_text") != F.lit("")) & c("_n_val").isNull(),
                            F.lit(ERR_MAX_EXAMPLES))).alias("_error"),
        # 0 = no limit: the evaluator treats a missing limit and 0 alike ("all")
        F.coalesce(F.when(c("_json"), c("_jmax")).otherwise(F.when(c("_n_text") != F.lit(""), c("_n_val"))),
                   F.lit(0).cast("bigint")).alias("max_examples"),
    )
    # No Filter above these projections (it would be pushed down and re-inline the
    # expensive expressions): both outputs are explodes of conditional arrays.
    per_req = st.select(
        "request_id", "max_examples",
        F.when(c("_error").isNull(), c("_cands")).alias("_out"),
        F.when(c("_error").isNotNull(), c("_error"))
         .when(F.size(c("_cands")) == 0, F.lit(MSG_NO_PARTICIPANTS)).alias("_err"),
    )
    per_req = per_req.checkpoint(eager=True)
    errors = per_req.select("request_id", F.explode(F.array_compact(F.array(c("_err")))).alias("error"))

    # inline_outer + a filter on the generated column: a plain inline would get an
    # inferred "size(_out) > 0" filter pushed below all the stages above, which
    # re-evaluates them; a filter on generator output stays above the generator.
    rows = per_req.select("request_id", "max_examples", F.inline_outer("_out"))
    rows = rows.filter(c("pos").isNotNull()).withColumnRenamed("pos", "position")
    e, role = c("e"), c("role")
    rows = rows.select("*", F.coalesce(_get(e, "name"), F.lit(DEFAULT_NAME)).alias("_lname"))
    is_tag, is_list, ej = c("url").isNotNull(), role.isNull(), c("ej")
    participants = rows.select(
        "request_id", c("position").cast("int").alias("position"),
        F.when(is_tag, F.lit(TAG_PARTICIPANT)).when(is_list, c("_lname")).otherwise(role).alias("name"),
        F.when(is_tag, F.lit(TAG_PARTICIPANT)).when(is_list, F.coalesce(_get(e, "agent_id"), c("_lname")))
         .when(ej.startswith('"'), role).otherwise(F.coalesce(_get(e, "agent_id"), role)).alias("agent_id"),
        F.when(is_tag, c("url")).when(ej.startswith('"'), F.try_variant_get(e, "$", "string"))
         .otherwise(_get(e, "endpoint")).alias("endpoint"),
        "max_examples",
    )
    return participants, errors
