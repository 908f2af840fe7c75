"""Properties that hold for all inputs: promotion, metadata and the script lexer."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera import Policy, Script, compare_schemas
from tessera import types as L
from tessera.plans.promotion import Clash, promote
from tessera.plans.script import tokens

units = st.sampled_from(L.UNITS)
leaves = st.one_of(
    st.sampled_from([L.NULL, L.BOOL, L.STRING, L.LARGE_STRING, L.STRING_VIEW, L.BINARY, L.LARGE_BINARY, L.DATE32, L.DATE64]),
    st.builds(L.integer, st.sampled_from([8, 16, 32, 64]), st.booleans()),
    st.builds(L.floating, st.sampled_from([16, 32, 64])),
    st.integers(1, 38).flatmap(lambda p: st.builds(L.decimal, st.just(p), st.integers(0, p))),
    st.builds(L.timestamp, units, st.sampled_from([None, "UTC", "Asia/Tokyo"])),
    st.builds(L.time, units),
)
kinds = st.recursive(
    leaves,
    lambda inner: st.one_of(
        st.builds(L.list_of, inner, st.sampled_from(["", "large"])),
        st.builds(L.map_of, leaves, inner),
        st.lists(st.tuples(st.sampled_from("abAB"), inner), min_size=1, max_size=3, unique_by=lambda f: f[0]).map(lambda f: L.struct_of(*f)),
    ),
    max_leaves=4,
)


@given(leaves, leaves)
@settings(max_examples=300, deadline=None)
def test_promotion_of_leaves_is_symmetric_and_absorbing(a, b):
    found, other = promote(a, b), promote(b, a)
    assert isinstance(found, Clash) == isinstance(other, Clash)
    if not isinstance(found, Clash):
        assert found == other and promote(found, a) == promote(a, found)
        assert not isinstance(promote(found, b), Clash)


@given(kinds)
@settings(max_examples=200, deadline=None)
def test_a_type_goes_with_itself_and_survives_metadata(k):
    assert promote(k, k) == k
    assert L.Kind.from_json(k.to_json()) == k
    assert compare_schemas([("c", k)], [("c", k)], Policy(strict_null_types=True)).ok


@given(st.lists(st.tuples(st.sampled_from(["a", "A", "b", "c"]), leaves), max_size=5))
@settings(max_examples=200, deadline=None)
def test_a_schema_equals_itself_unless_names_repeat(fields):
    folded = [n.casefold() for n, _ in fields]
    assert compare_schemas(fields, fields).ok == (len(set(folded)) == len(folded))


pieces = st.sampled_from(["select", " ", "(", ")", ";", ",", "--c\n", "/* x */", "'a;''(b'", '"q;"', "`t``;`", "x1", "\n", "-", "="])


@given(st.lists(pieces, max_size=40).map("".join))
@settings(max_examples=300, deadline=None)
def test_the_lexer_is_faithful(sql):
    found = tokens(sql)
    assert all(sql[t.start : t.end] == t.value for t in found)
    assert all(a.end <= b.start for a, b in zip(found, found[1:]))
    assert all(t.depth >= 0 for t in found)
    script = Script(sql)
    assert all(sql[a:b].strip() for a, b in script.statements)
    assert script.tags == []
