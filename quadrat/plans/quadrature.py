"""Tail probabilities as SQL text, by Simpson's rule over ``range()``: they share nothing with the library's own functions."""


def simpson(integrand, low: str, high: str, panels: int = 2000) -> str:
    """Integral of ``integrand(u)`` (SQL text from SQL text) from ``low`` to ``high``; ``panels`` is even."""
    width = f"((({high}) - ({low})) / {panels})"
    weight = f"(CASE WHEN i = 0 OR i = {panels} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"({width} / 3 * list_sum(list_transform(range(0, {panels + 1}), lambda i: {weight} * {integrand(f'(({low}) + i * {width})')})))"


def _density(u: str) -> str:
    return f"(exp(-{u} * {u} / 2) / sqrt(2 * pi()))"


def normal_tail(z: str) -> str:
    """P(Z > z)."""
    return simpson(_density, z, f"greatest({z}, 0) + 9")


def f_tail(f: str, df1: str, df2: str) -> str:
    """P(F > f), as an integral over the angle whose squared tangent is df1 f / df2."""
    start = f"atan(sqrt(({df1}) * ({f}) / ({df2})))"
    front = f"(2 * exp(lgamma((({df1}) + ({df2})) / 2.0) - lgamma(({df1}) / 2.0) - lgamma(({df2}) / 2.0)))"
    area = simpson(lambda u: f"(pow(sin({u}), ({df1}) - 1) * pow(greatest(cos({u}), 0), ({df2}) - 1))", start, f"least(pi() / 2, {start} + 14 / sqrt({df2}))")
    return f"({front} * {area})"


def t_tail(t: str, df: str) -> str:
    """P(|T| > |t|)."""
    return f_tail(f"({t}) * ({t})", "1", df)


def range_tail(q: str, k: int) -> str:
    """P(range of k standard normals > q)."""
    width, step = f"(({q}) / 200)", "0.03"
    inner = (f"({width} / 3 * list_sum(list_transform(range(0, 201), lambda j: (CASE WHEN j = 0 OR j = 200 THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) * "
             f"exp(-pow(-8 + i * {step} - j * {width}, 2) / 2) / sqrt(2 * pi()))))")
    area = (f"({step} / 3 * list_sum(list_transform(range(0, 601), lambda i: (CASE WHEN i = 0 OR i = 600 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * "
            f"exp(-pow(-8 + i * {step}, 2) / 2) / sqrt(2 * pi()) * pow({inner}, {k - 1}))))")
    return f"(1 - {k} * {area})"
