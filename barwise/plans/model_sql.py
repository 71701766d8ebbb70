"""SQL of a stated number of plain steps of the models: one common table expression per half step."""

from __future__ import annotations

FLOOR, LEAST_WEIGHT, START_FLOOR, LEAST_ROWS = 1e-6, 1e-10, 1e-3, 50
LOG_2PI = "ln(2 * pi())"


def _join(parts, by: str = ", ") -> str:
    return by.join(parts)


def _inverse(d: int) -> tuple[str, list[list[str]]]:
    """Determinant and adjugate of the symmetric matrix with the cells ``c11``, ``c12``, .."""
    c = [[f"c{min(i, j) + 1}{max(i, j) + 1}" for j in range(d)] for i in range(d)]
    if d == 2:
        return f"{c[0][0]} * {c[1][1]} - {c[0][1]} * {c[0][1]}", [[c[1][1], f"-{c[0][1]}"], [f"-{c[0][1]}", c[0][0]]]

    def minor(i: int, j: int) -> str:
        r, s = [x for x in range(3) if x != i], [x for x in range(3) if x != j]
        return f"({c[r[0]][s[0]]} * {c[r[1]][s[1]]} - {c[r[0]][s[1]]} * {c[r[1]][s[0]]})"

    adjugate = [[f"{'-' if (i + j) % 2 else ''}{minor(j, i)}" for j in range(3)] for i in range(3)]
    return _join([f"{c[0][j]} * {adjugate[j][0]}" for j in range(3)], " + "), adjugate


def mixture(tag: str, columns: list[str], k: int, steps: int) -> dict[str, str]:
    """Tables ``<tag>_p<t>`` of parameters per symbol and component, and ``<tag>_r<t>`` of posteriors per row and component."""
    d = len(columns)
    x = [f"x{i + 1}" for i in range(d)]
    cells = [(i, j) for i in range(d) for j in range(i, d)]
    named = _join([f"coalesce({c}, 0) AS {v}" for c, v in zip(columns, x, strict=True)])
    out = {
        f"{tag}_x": f"SELECT symbol, time, {named} FROM reg_h WHERE symbol IN (SELECT symbol FROM reg_h GROUP BY 1 HAVING count(*) >= {LEAST_ROWS})",
        f"{tag}_g": f"""SELECT *, ((row_number() OVER (PARTITION BY symbol ORDER BY x1, time) - 1) * {k})
            // (count(*) OVER (PARTITION BY symbol)) AS g FROM {tag}_x""",
        f"{tag}_r0": f"SELECT symbol, time, {_join(x)}, c, (g = c)::DOUBLE AS r FROM {tag}_g, (SELECT unnest(range({k})) AS c)",
    }
    det, adjugate = _inverse(d)
    distance = _join([f"(x{i + 1} - m{i + 1}) * ({adjugate[i][j]}) * (x{j + 1} - m{j + 1})" for i in range(d) for j in range(d)], " + ")
    for t in range(steps + 1):
        sums = [f"sum(r * {v}) / greatest(sum(r), {LEAST_WEIGHT}) AS m{i + 1}" for i, v in enumerate(x)]
        sums += [f"sum(r * {x[i]} * {x[j]}) / greatest(sum(r), {LEAST_WEIGHT}) AS q{i + 1}{j + 1}" for i, j in cells]
        spreads = [
            f"greatest(q{i + 1}{j + 1} - m{i + 1} * m{j + 1}, 0) + {FLOOR} AS c{i + 1}{j + 1}" if i == j
            else f"q{i + 1}{j + 1} - m{i + 1} * m{j + 1} AS c{i + 1}{j + 1}"
            for i, j in cells
        ]
        out[f"{tag}_s{t}"] = f"SELECT symbol, c, greatest(sum(r), {LEAST_WEIGHT}) AS n, sum(r) AS held, {_join(sums)} FROM {tag}_r{t} GROUP BY 1, 2"
        out[f"{tag}_c{t}"] = f"SELECT *, n / sum(held) OVER (PARTITION BY symbol) AS w, {_join(spreads)} FROM {tag}_s{t}"
        out[f"{tag}_p{t}"] = f"SELECT *, greatest({det}, {FLOOR ** d}) AS det, row_number() OVER (PARTITION BY symbol ORDER BY m1, c) - 1 AS place FROM {tag}_c{t}"
        out[f"{tag}_l{t}"] = f"""SELECT symbol, time, {_join(x)}, c, place, ln(w) - (ln(det) + ({distance}) / det + {d} * {LOG_2PI}) / 2 AS l
            FROM {tag}_x JOIN {tag}_p{t} USING (symbol)"""
        out[f"{tag}_t{t}"] = f"SELECT *, max(l) OVER (PARTITION BY symbol, time) AS top FROM {tag}_l{t}"
        out[f"{tag}_r{t + 1}"] = f"""SELECT symbol, time, {_join(x)}, c, place, exp(l - top) / sum(exp(l - top)) OVER (PARTITION BY symbol, time) AS r
            FROM {tag}_t{t}"""
    return out


def clusters(tag: str, steps: int) -> str:
    """Statistics of the clusters after ``steps``."""
    return f"""SELECT symbol, place AS cluster, round(avg(x1), 4) AS mean_volatility, round(avg(x2), 4) AS mean_volume, count(*) AS count,
        CASE WHEN avg(x1) > 0.06 AND avg(x2) > 5 THEN 'high_vol_high_volume' WHEN avg(x1) > 0.06 THEN 'high_vol_low_volume'
        WHEN avg(x1) <= 0.03 AND avg(x2) > 5 THEN 'low_vol_high_volume' ELSE 'low_vol_low_volume' END AS regime_label,
        bool_or(newest) AS is_current, round(max(r) FILTER (newest), 4) AS confidence
        FROM (SELECT *, time = max(time) OVER (PARTITION BY symbol) AS newest FROM (SELECT * FROM {tag}_r{steps + 1}
            QUALIFY row_number() OVER (PARTITION BY symbol, time ORDER BY r DESC, place) = 1)) GROUP BY 1, 2"""


def newest(tag: str, steps: int, names: list[str]) -> str:
    """Name and posteriors of the newest row after ``steps``."""
    labels = "[" + _join([f"'{n}'" for n in names]) + "]"
    each = _join([f"round(max(r) FILTER (place = {j}), 4) AS p{j}" for j in range(len(names))])
    return f"""SELECT symbol, {labels}[arg_max(place, r) + 1] AS regime, round(max(r), 4) AS confidence, {each}
        FROM (SELECT * FROM {tag}_r{steps + 1} QUALIFY time = max(time) OVER (PARTITION BY symbol)) GROUP BY symbol"""


def markov(tag: str, columns: list[str], k: int, stay: float) -> dict[str, str]:
    """Forward pass at first parameters (groups by the first feature, moves that stay with probability ``stay``), one plain step of the fit, and
    the forward pass after it: ``<tag>_f0`` and ``<tag>_f1``, the newest rows with the log likelihood in ``ll``."""
    d, states = len(columns), range(k)
    x = [f"x{i + 1}" for i in range(d)]
    named = _join([f"coalesce({c}, 0) AS {v}" for c, v in zip(columns, x, strict=True)])
    moves = [[str(stay if i == j else (1 - stay) / (k - 1)) for j in states] for i in states]
    out = {
        f"{tag}_x": f"""SELECT symbol, time, {named}, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS pos FROM reg_h
            WHERE symbol IN (SELECT symbol FROM reg_h GROUP BY 1 HAVING count(*) >= {LEAST_ROWS})""",
        f"{tag}_g": f"""SELECT *, ((row_number() OVER (PARTITION BY symbol ORDER BY x1, time) - 1) * {k})
            // (count(*) OVER (PARTITION BY symbol)) AS g FROM {tag}_x""",
        f"{tag}_p0": f"SELECT symbol, {_join([f'1.0 / {k} AS s{j}' for j in states])}, "
        + _join([f"{moves[i][j]} AS t{i}{j}" for i in states for j in states]) + ", "
        + _join([f"avg({v}) FILTER (g = {c}) AS m{c}_{i}" for c in states for i, v in enumerate(x)]) + ", "
        + _join([f"greatest(avg({v} * {v}) FILTER (g = {c}) - (avg({v}) FILTER (g = {c})) ** 2, 0) + {START_FLOOR} AS v{c}_{i}" for c in states for i, v in enumerate(x)])
        + f" FROM {tag}_g GROUP BY symbol",
    }

    def forward(t: int) -> None:
        dense = [" + ".join(f"(-0.5 * ({LOG_2PI} + ln(v{c}_{i}) + ({v} - m{c}_{i}) ** 2 / v{c}_{i}))" for i, v in enumerate(x)) for c in states]
        logs = _join([f"{e} AS b{c}" for c, e in enumerate(dense)])
        out[f"{tag}_b{t}"] = f"SELECT symbol, pos, {_join(x)}, {logs} FROM {tag}_x JOIN {tag}_p{t} USING (symbol)"
        top = f"greatest({_join([f'b{c}' for c in states])})"
        out[f"{tag}_e{t}"] = f"SELECT symbol, pos, {_join(x)}, {top} AS top, {_join([f'exp(b{c} - {top}) AS e{c}' for c in states])} FROM {tag}_b{t}"
        opening = [f"s{j} * e{j}" for j in states]
        moved = ["(" + _join([f"f.a{i} * t{i}{j}" for i in states], " + ") + f") * e{j}" for j in states]
        total = lambda parts: "(" + _join(parts, " + ") + ")"
        out[f"{tag}_a{t}"] = f"""SELECT symbol, pos, {_join([f'{o} / {total(opening)} AS a{j}' for j, o in enumerate(opening)])}, ln({total(opening)}) + top AS ll
            FROM {tag}_e{t} JOIN {tag}_p{t} USING (symbol) WHERE pos = 0
            UNION ALL SELECT e.symbol, e.pos, {_join([f'{m} / {total(moved)}' for m in moved])}, f.ll + ln({total(moved)}) + e.top
            FROM {tag}_a{t} f JOIN {tag}_e{t} e ON e.symbol = f.symbol AND e.pos = f.pos + 1 JOIN {tag}_p{t} p ON p.symbol = f.symbol"""
        out[f"{tag}_f{t}"] = f"SELECT * FROM {tag}_a{t} QUALIFY pos = max(pos) OVER (PARTITION BY symbol)"

    forward(0)
    after = ["(" + _join([f"t{i}{j} * e.e{j} * n.u{j}" for j in states], " + ") + ")" for i in states]
    every = "(" + _join(after, " + ") + ")"
    out[f"{tag}_u0"] = f"""SELECT symbol, pos, {_join([f'1.0 / {k} AS u{i}' for i in states])} FROM {tag}_f0
        UNION ALL SELECT e.symbol, e.pos - 1, {_join([f'{a} / {every}' for a in after])}
        FROM {tag}_u0 n JOIN {tag}_e0 e ON e.symbol = n.symbol AND e.pos = n.pos JOIN {tag}_p0 p ON p.symbol = n.symbol WHERE n.pos > 0"""
    shares = "(" + _join([f"a{i} * u{i}" for i in states], " + ") + ")"
    out[f"{tag}_h0"] = f"""SELECT symbol, pos, {_join(x)}, {_join([f'a{i} * u{i} / {shares} AS h{i}' for i in states])}
        FROM {tag}_a0 JOIN {tag}_u0 USING (symbol, pos) JOIN {tag}_e0 USING (symbol, pos)"""
    joint = [[f"l.a{i} * t{i}{j} * e{j} * u{j}" for j in states] for i in states]
    whole = "(" + _join([x for row in joint for x in row], " + ") + ")"
    out[f"{tag}_k0"] = f"""SELECT l.symbol, {_join([f'sum({joint[i][j]} / {whole}) AS k{i}{j}' for i in states for j in states])}
        FROM {tag}_a0 l JOIN {tag}_e0 e ON e.symbol = l.symbol AND e.pos = l.pos + 1 JOIN {tag}_u0 u ON u.symbol = l.symbol AND u.pos = l.pos + 1
        JOIN {tag}_p0 p ON p.symbol = l.symbol GROUP BY l.symbol"""
    rows = [_join([f"k{i}{j}" for j in states], " + ") for i in states]
    out[f"{tag}_w0"] = "SELECT symbol, " + _join([f"max(h{c}) FILTER (pos = 0) AS s{c}, greatest(sum(h{c}), {LEAST_WEIGHT}) AS n{c}" for c in states]) + ", " + _join(
        [f"sum(h{c} * {v}) / greatest(sum(h{c}), {LEAST_WEIGHT}) AS m{c}_{i}, sum(h{c} * {v} * {v}) / greatest(sum(h{c}), {LEAST_WEIGHT}) AS q{c}_{i}" for c in states for i, v in enumerate(x)]
    ) + f" FROM {tag}_h0 GROUP BY symbol"
    out[f"{tag}_p1"] = (
        f"SELECT symbol, {_join([f's{c}' for c in states])}, {_join([f'CASE WHEN {rows[i]} > 0 THEN k{i}{j} / ({rows[i]}) ELSE 1.0 / {k} END AS t{i}{j}' for i in states for j in states])}, "
        + _join([f"m{c}_{i}" for c in states for i in range(d)]) + ", " + _join([f"greatest(q{c}_{i} - m{c}_{i} ** 2, 0) + {FLOOR} AS v{c}_{i}" for c in states for i in range(d)])
        + f" FROM {tag}_w0 JOIN {tag}_k0 USING (symbol)"
    )
    forward(1)
    return out


def markov_newest(tag: str, t: int, k: int) -> str:
    """Log likelihood and posteriors of the newest row, states by rising mean of the first feature."""
    ranked = f"list_sort([{_join([f'struct_pack(m := m{c}_0, c := {c}, a := a{c})' for c in range(k)])}])"
    each = _join([f"round(z[{j + 1}].a, 4) AS p{j}" for j in range(k)])
    return f"""SELECT symbol, round(ll, 4) AS log_likelihood, {each} FROM (SELECT symbol, ll, {ranked} AS z FROM {tag}_f{t} JOIN {tag}_p{t} USING (symbol))"""
