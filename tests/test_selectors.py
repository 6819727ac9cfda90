"""The selector language over the fixture graph."""

import fixture_graph
import pytest
from pyspark.sql import functions as F

from graphweft.plans.compiler import package_id, select
from graphweft.plans.parser import QueryError, parse

ROOT, A, B, C = "query-selector-all-tests@1.0.0", "a@1.0.0", "b@1.0.0", "c@1.0.0"
SCOPED, ABBREV, BAR, OLD_BAR, BAZ = "@npmcli/abbrev@2.0.0-beta.45", "abbrev@1.1.1", "bar@2.0.0", "bar@1.4.0", "baz@1.0.0"
DASH, DASHER, FOO, IPSUM, LOREM, MOO = "dash-separated-pkg@1.0.0", "dasher@2.0.0", "foo@2.2.2", "ipsum@npm:sit@1.0.0", "lorem@1.0.0", "moo@3.0.0"
RECUR, SIVE = "recur@1.0.0", "sive@1.0.0"
ALL = [ROOT, A, B, C, SCOPED, ABBREV, BAR, BAZ, DASH, DASHER, FOO, OLD_BAR, IPSUM, LOREM, MOO, RECUR, SIVE]


def but(*names):
    return [x for x in ALL if x not in names]


CASES = [
    ("", []), ("*", ALL), ("* > *", but(ROOT, SCOPED)), ("> #a", [A]), (":root", [ROOT]), (":scope", [ROOT]),
    (":root > *", [A, B, C, ABBREV, BAR, FOO, IPSUM, MOO, RECUR]), (":root > *.workspace", [A, B, C]), (":root > .workspace[name=a]", [A]),
    (":root > [name=bar]", [BAR]), (":root > .workspace[version=1.0.0]", [A, B, C]), (":root > :root", []), ("* :root", []), (":root, :root", [ROOT]), ("#a ~ :root", []),
    (":empty", [SCOPED, A, ABBREV, B, C, DASH, DASHER, LOREM, MOO]), (":root > :empty", [A, ABBREV, B, C, MOO]),
    (":extraneous", [SCOPED]), (":invalid", [LOREM]), (":link", [A, B, C]), (":deduped", [BAR, MOO, RECUR]), (":missing", ["missing-dep@^1.0.0"]), (":private", [B]), (":overridden", [DASHER]),
    (":not(#foo)", but(FOO)), (":root > .workspace:not(#b)", [A, C]), (":root > .workspace > *:not(#bar)", [A, B, BAZ]),
    (".bundled ~ :not(.workspace)", [BAR, FOO, IPSUM, MOO, RECUR]), ("*:root > *:empty:not(*[name^=a], #b, #c)", [MOO]), (":not(:not(:link))", [A, B, C]),
    (":root > *:has(* > #bar:semver(1.4.0))", [FOO]), ("*:has(> #bar:semver(1.4.0))", [FOO]), (".workspace:has(> * > #lorem)", [A]), (".workspace:has(* #lorem, ~ #b)", [A, B, C]),
    (":is(#a, #b) > *", [A, BAR, BAZ]), (":root > *:is(.prod:not(:empty), .dev > [name=bar]) > *", [A, B, BAR, BAZ, DASHER, MOO]), (":is(*:semver(2.0.0), :semver(=2.0.0-beta.45))", [SCOPED, BAR, DASHER]),
    (":type()", ALL), (":type(tag)", [LOREM]), (":type(alias)", [IPSUM]), (":type(range)", [A, ABBREV, B, BAR, BAZ, DASH, FOO, OLD_BAR, MOO]), (":type(git)", []),
    (":path(node_modules/*)", [ABBREV, BAR, BAZ, DASH, DASHER, FOO, IPSUM, LOREM, MOO, RECUR, SIVE]), (":path(./node_modules/bar)", [BAR]), (":path(node_modules/foo/node_modules/bar)", [OLD_BAR]),
    (":path(**/bar)", [BAR, OLD_BAR]), (":path(*)", [A, B, C]), (":path()", ALL),
    (":semver()", ALL), (":semver(*)", but(SCOPED)), (":semver(2.0.0)", [BAR, DASHER]), (":semver(>=2)", [BAR, DASHER, FOO, MOO]), (":semver(~2.0.x)", [BAR, DASHER]), (":semver(2 - 3)", [BAR, DASHER, FOO, MOO]),
    (":semver(1.4.0 || 2.2.2)", [FOO, OLD_BAR]), (":semver(^16.0.0, :attr(engines, [node]))", [ABBREV, BAR]), (":semver(18.0.0, :attr(engines, [node]))", [BAR]), (':semver(^16.0.0, :attr(engines, [node^=">="]))', [BAR]),
    (":semver(3.0.0, [version], eq)", [MOO]), (":semver(^3.0.0, [version], eq)", []), (":semver(1.0.0, [version], neq)", [SCOPED, ABBREV, BAR, DASHER, FOO, OLD_BAR, MOO]), (":semver(2.0.0, [version], gt)", [FOO, MOO]),
    (":semver(2.0.0, [version], gte)", [BAR, DASHER, FOO, MOO]), (":semver(1.1.1, [version], lt)", [ROOT, A, B, C, BAZ, DASH, IPSUM, LOREM, RECUR, SIVE]), (":semver(^1.1.1, [version], ltr)", [ROOT, A, B, C, BAZ, DASH, IPSUM, LOREM, RECUR, SIVE]),
    ("#bar", [BAR, OLD_BAR]), ("#bar@2.0.0", [BAR]), ("#bar > *", [DASHER, MOO]), (":root #bar:semver(1) ~ *", [DASH]), ("#b *", [A, BAR, BAZ, LOREM, MOO]),
    (".workspace .workspace .workspace", [A]), (".dev *", [BAZ, DASH, DASHER, OLD_BAR, LOREM, RECUR, SIVE]), (".peer", [SCOPED, DASHER]), (".bundled", [ABBREV]),
    (":outdated(major)", [DASH, OLD_BAR]), (":outdated(in-range)", [ABBREV, BAZ]), (":outdated(patch)", [BAZ]), (":vuln", [FOO, SIVE]), (":vuln([cwe])", [SIVE]), (":vuln([severity=high])", [FOO]), (":vuln([cwe=123])", [SIVE]),
    (":attr([keywords=lorem])", [IPSUM, LOREM]), (":attr(arbitrary, :attr([foo=10000]))", [BAR]), ("[name|=dash]", [DASH]), ("[license=isc i]", [ABBREV, BAZ]), ("[scripts]", [BAZ]), ('[description~="library"]', [DASHER]), ("[arbitrary^=foo]", [FOO]),
]


@pytest.fixture(scope="module")
def graph(spark):
    return fixture_graph.build(spark)


def found(graph, query, **options):
    rows = select(graph, query, **options).select(package_id(F.col("name"), F.coalesce("package_name", "name"), F.col("version")))
    return sorted({r[0] for r in rows.collect()})


@pytest.mark.parametrize(("query", "expected"), CASES, ids=[c[0] or "empty" for c in CASES])
def test_selector(graph, query, expected):
    assert found(graph, query) == sorted(expected)


def test_scope_and_age(graph):
    assert found(graph, ":scope > *", scope="node_modules/foo") == sorted([DASH, OLD_BAR])
    assert found(graph, ":outdated", before=str(fixture_graph.YESTERDAY)) == sorted([ABBREV, BAZ, DASH])


@pytest.mark.parametrize(
    ("query", "code"),
    [(":foo", "EQUERYNOPSEUDO"), (".foo", "EQUERYNODEPTYPE"), (":attr(foo, bar)", "EQUERYATTR"), ("node", "EQUERYNOSELECTOR"), (":semver(1.0.0, [version], eqqq)", "EQUERYINVALIDOPERATOR"), (":semver(nope)", "EQUERYINVALIDSEMVER")],
)
def test_mistakes(graph, query, code):
    with pytest.raises(QueryError) as e:
        select(graph, query)
    assert e.value.code == code


def test_parser():
    assert [t.kind for t in parse("#a > .dev[x=1]")[0]] == ["id", "combinator", "class", "attribute"]
    assert parse("#@s/n")[0][0].value == "@s/n"
