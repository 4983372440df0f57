"""SQL twins of the fixed-effects estimators: closed forms, valid on balanced panels.

Controls leave one at a time (Frisch-Waugh-Lovell with window sums), so every step is plain SQL.
"""

from __future__ import annotations


def fe_ctes(
    rel: str,
    y: str,
    xs: list[str],
    *,
    tag: str = "f",
    group: str | None = None,
    time: bool = True,
    unit: str = "unit",
    period: str = "year",
) -> dict[str, str]:
    """CTEs ending in ``{tag}fit``: [group,] coef, se, n, units, periods of the first regressor, and
    ``{tag}res``: unit, period, x, y, e."""
    g = f"{group}, " if group else ""
    by_all = f"partition by {group}" if group else ""
    cols = [y, *xs]
    need = " and ".join(f"{c} is not null" for c in cols)

    def dev(c: str) -> str:
        out = f"{c} - avg({c}) over (partition by {g}{unit})"
        if time:
            out += f" - avg({c}) over (partition by {g}{period}) + avg({c}) over ({by_all})"
        return f"{out} as {c}"

    ctes = {f"{tag}0": f"select {g}{unit}, {period}, {', '.join(dev(c) for c in cols)} from {rel} where {need}"}
    prev, left = f"{tag}0", list(cols)
    for i, c in enumerate(xs[1:], start=1):
        left = [v for v in left if v != c]
        step = ", ".join(f"{v} - {c} * (sum({v} * {c}) over ({by_all}) / sum({c} * {c}) over ({by_all})) as {v}" for v in left)
        ctes[f"{tag}{i}"] = f"select {g}{unit}, {period}, {step} from {prev}"
        prev = f"{tag}{i}"
    x = xs[0]
    using = f" join {tag}b using ({group})" if group else f", {tag}b"
    tail = f" group by {group}" if group else ""
    slopes = f"({len(xs)} + count(distinct {period}))" if time else f"{len(xs) + 1}"
    ctes[f"{tag}b"] = (
        f"select {g}sum({x} * {y}) / sum({x} * {x}) as b, sum({x} * {x}) as sxx, count(*) as n, count(distinct {unit}) as gg, "
        f"count(distinct {period}) as tt, {slopes} as slopes from {prev}{tail}"
    )
    ctes[f"{tag}res"] = f"select {g}{unit}, {period}, {x} as x, {y} as y, {y} - b * {x} as e from {prev}{using}"
    ctes[f"{tag}s"] = f"select {g}{unit}, sum(x * e) as sg from {tag}res group by {g}{unit}"
    ctes[f"{tag}m"] = f"select {g}sum(sg * sg) as meat from {tag}s{tail}"
    join = f"{tag}b join {tag}m using ({group})" if group else f"{tag}b, {tag}m"
    ctes[f"{tag}fit"] = (
        f"select {g}b as coef, sqrt(meat) / sxx * sqrt(gg::double / (gg - 1) * (n - 1) / (n - slopes)) as se, n, gg as units, "
        f"tt as periods, sqrt(sxx / (n - 1)) as sd_identifying from {join}"
    )
    return ctes


def with_more(base: str, ctes: dict[str, str]) -> str:
    """Append CTEs to a ``with`` clause."""
    return base.rstrip() + ",\n" + ",\n".join(f"{k} as ({v})" for k, v in ctes.items()) + "\n"


def t_two_sided_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t for even degrees of freedom, as a finite sum."""
    return (
        f"1 - sin(atan(abs({t}) / sqrt({df}))) * list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) "
        f"* pow(cos(atan(abs({t}) / sqrt({df}))), 2 * k) for k in range(0, ({df})::bigint // 2)])"
    )


def t_975_sql(df: str) -> str:
    """The 0.975 quantile of Student's t, expanded in powers of 1 / df from the normal quantile."""
    z = "1.959963984540054::double"
    return (
        f"({z} + (pow({z}, 3) + {z}) / (4 * {df}) + (5 * pow({z}, 5) + 16 * pow({z}, 3) + 3 * {z}) / (96 * pow({df}, 2)) "
        f"+ (3 * pow({z}, 7) + 19 * pow({z}, 5) + 17 * pow({z}, 3) - 15 * {z}) / (384 * pow({df}, 3)) "
        f"+ (79 * pow({z}, 9) + 776 * pow({z}, 7) + 1482 * pow({z}, 5) - 1920 * pow({z}, 3) - 945 * {z}) / (92160 * pow({df}, 4)))"
    )


# The weights of a cluster drawn from the md5 ``h``.
RADEMACHER_SQL = "case when substr(h, 1, 1) in ('0', '2', '4', '6', '8', 'a', 'c', 'e') then 1.0::double else -1.0::double end"
WEBB_SQL = "[-sqrt(1.5), -1.0, -sqrt(0.5), sqrt(0.5), 1.0, sqrt(1.5)][(('0x' || substr(h, 1, 8))::bigint % 6 + 1)::int]"


def wild_ctes(rel: str, y: str, xs: list[str], weight: str, nulls: str = "select 0.0::double as b0", *, tag: str = "w", replicas: int = 999):
    """CTEs ending in ``{tag}fit`` and ``{tag}t``: (b0, r, t, seen), every replica's statistic under every null value.

    A replica flips whole units; periods and controls are taken out of it again, the controls one at a time by the
    columns that ``fe_ctes`` leaves of them.
    """
    ctes = fe_ctes(rel, y, xs, tag=tag)
    ks = [f"k{j}" for j in range(len(xs) - 1)]
    joins = " ".join(f"join {tag}{j} r{j} using (unit, year)" for j in range(len(ks)))
    basis = "".join(f", r{j}.{c} as k{j}" for j, c in enumerate(xs[1:]))
    keep = "".join(f", {k}" for k in ks)
    ctes[f"{tag}x"] = f"select unit, year, f.x, f.y{basis} from {tag}res f {joins}"
    ctes[f"{tag}nulls"] = nulls
    ctes[f"{tag}draws"] = (
        f"select r, unit, {weight} as w from (select r, unit, md5('7|' || r::varchar || '|' || unit::varchar) as h from "
        f"(select unnest(range(1, {replicas + 1})) as r), (select distinct unit from {tag}x))"
    )
    ctes[f"{tag}v"] = f"select b0, r, unit, year, x{keep}, (y - b0 * x) * w as v from {tag}x join {tag}draws using (unit), {tag}nulls"
    ctes[f"{tag}v0"] = f"select b0, r, unit, year, x{keep}, v - avg(v) over (partition by b0, r, year) as v from {tag}v"
    for j, k in enumerate(ks, 1):
        load = f"(sum(v * {k}) over (partition by b0, r) / sum({k} * {k}) over (partition by b0, r))"
        ctes[f"{tag}v{j}"] = f"select b0, r, unit, year, x{keep}, v - {k} * {load} as v from {tag}v{j - 1}"
    last = f"{tag}v{len(ks)}"
    ctes[f"{tag}n"] = f"select b0, r, sum(x * v) / sum(x * x) as n1 from {last} group by 1, 2"
    ctes[f"{tag}sc"] = f"select b0, r, unit, any_value(n1) as n1, sum(x * (v - n1 * x)) as s from {last} join {tag}n using (b0, r) group by 1, 2, 3"
    ctes[f"{tag}t"] = (
        f"select b0, r, any_value(n1) / (sqrt(sum(s * s)) / any_value(sxx)) as t, any_value((b - b0) / (sqrt(meat) / sxx)) as seen "
        f"from {tag}sc, {tag}b, {tag}m group by 1, 2"
    )
    return ctes


def wild_row(tag: str = "w") -> str:
    """One row as ``symmetric_p`` gives it."""
    return (
        f"select coef, se, coef / se as t, (select (count(*) filter (where abs(t) >= abs(seen) - 1e-12) + 1)::double / (count(*) + 1) from {tag}t) "
        f"as p_bootstrap, (select count(*) from {tag}t) as replicas from {tag}fit"
    )
