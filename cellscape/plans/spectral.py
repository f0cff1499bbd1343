"""Queries on spectra (A11, B27-B35, E5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellscape.operators import catalog
from cellscape.operators import spectral as ops
from cellscape.plans.fixtures import view
from cellscape.plans.registry import query

_s = lambda s, d: view(s, d, "spectra")
_b = lambda s, d: view(s, d, "band_catalog")
_at = lambda nm: f"spectrum[CAST(round(({nm} - 400) / 32.0) AS INT) + 1]"
query("wl_subset", f"SELECT vec_id, {_at(656)} AS nm_656, {_at(848)} AS nm_848 FROM spectra", "spectra")(lambda s, d: ops.wavelength_subset(_s(s, d), _b(s, d), [656.0, 848.0]))
query("spectral_ratio", f"SELECT vec_id, {_at(848)} / nullif({_at(656)}, 0) AS value FROM spectra", "spectra")(lambda s, d: ops.ratio(_s(s, d), _b(s, d), 848.0, 656.0))
query("nd_wavelength", f"SELECT vec_id, ({_at(848)} - {_at(656)}) / nullif({_at(848)} + {_at(656)}, 0) AS value FROM spectra", "spectra")(lambda s, d: ops.normalized_ratio(_s(s, d), _b(s, d), 848.0, 656.0))
query("absorption_depth", f"__l AS (SELECT vec_id, {_at(2192)} AS f, {_at(2096)} + ({_at(2288)} - {_at(2096)}) * 0.5 AS line FROM spectra) SELECT vec_id, round_even(CASE WHEN line > 0 THEN 1 - f / line END, 9) AS depth FROM __l", "spectra")(
    lambda s, d: ops.absorption_depth(_s(s, d), _b(s, d), 2192.0, 2096.0, 2288.0).withColumn("depth", F.bround("depth", 9))
)
query("band_at", "SELECT band FROM instrument_bands ORDER BY abs(wl_nm - 1000), band LIMIT 1", "instrument_bands")(lambda s, d: view(s, d, "instrument_bands").filter(F.col("band") == catalog.band_at(view(s, d, "instrument_bands"), 1000.0, 2101.0)).select("band"))
_MEAN = "__e AS (SELECT label, unnest(spectrum) AS v, unnest(range(64)) AS band FROM spectra), __m AS (SELECT label, band, avg(v) AS v FROM __e GROUP BY ALL), __r AS (SELECT list(v ORDER BY band) AS ref FROM __m WHERE label = 0)"
query("spectral_angle", f"{_MEAN} SELECT vec_id, round_even(acos(greatest(-1.0, least(1.0, list_dot_product(spectrum, ref) / (sqrt(list_dot_product(spectrum, spectrum)) * sqrt(list_dot_product(ref, ref)))))), 6) AS angle FROM spectra, __r", "spectra")(
    lambda s, d: ops.spectral_angle(_s(s, d), ops.endmembers(_s(s, d), [0])[:, 0]).withColumn("angle", F.bround("angle", 6))
)
query("spectral_signature", f"{_MEAN} SELECT label, CAST(band AS INT) AS band, round_even(v, 9) AS value FROM __m", "spectra")(lambda s, d: ops.mean_spectra(_s(s, d), "label").withColumn("value", F.bround("value", 9)))
# In DuckDB the normal equations of three members are solved by Cramer's rule.
_G = lambda i, j: f"list_dot_product(m{i}, m{j})"
_Y = lambda i: f"list_dot_product(m{i}, spectrum)"


def _det(a):
    return f"({a[0][0]} * ({a[1][1]} * {a[2][2]} - {a[1][2]} * {a[2][1]}) - {a[0][1]} * ({a[1][0]} * {a[2][2]} - {a[1][2]} * {a[2][0]}) + {a[0][2]} * ({a[1][0]} * {a[2][1]} - {a[1][1]} * {a[2][0]}))"


_A = [[_G(i, j) for j in range(3)] for i in range(3)]
_X = [f"{_det([[_Y(i) if j == k else _A[i][j] for j in range(3)] for i in range(3)])} / {_det(_A)}" for k in range(3)]
query("unmix_ucls", f"{_MEAN}, __k AS (SELECT {', '.join(f'(SELECT list(v ORDER BY band) FROM __m WHERE label = {i}) AS m{i}' for i in range(3))}) SELECT vec_id, {', '.join(f'round_even({x}, 5) AS a{k}' for k, x in enumerate(_X))} FROM spectra, __k", "spectra")(
    lambda s, d: ops.unmix_ucls(_s(s, d), ops.endmembers(_s(s, d), [0, 1, 2])).select("vec_id", *[F.bround(F.col("abundance")[k], 5).alias(f"a{k}") for k in range(3)])
)
query("unmix_fcls")(lambda s, d: ops.unmix_fcls(_s(s, d), ops.endmembers(_s(s, d), [0, 1, 2])))
# In DuckDB: the hull over a band is the highest of all chords over it.
query("continuum_removal", "__e AS (SELECT vec_id, label, unnest(spectrum) AS y, unnest(range(64)) AS k FROM spectra), __c AS (SELECT a.vec_id, a.k AS i, b.k AS j, a.y AS yi, b.y AS yj FROM __e a JOIN __e b ON b.vec_id = a.vec_id AND b.k > a.k), __h AS (SELECT e.vec_id, e.label, e.k, e.y, greatest(e.y, max(yi + (yj - yi) * (e.k - i) / (j - i))) AS line FROM __e e JOIN __c c ON c.vec_id = e.vec_id AND c.i <= e.k AND e.k <= c.j GROUP BY e.vec_id, e.label, e.k, e.y) SELECT vec_id, label, CAST(k AS INT) AS band, round_even(CASE WHEN line > 0 THEN y / line END, 6) AS removed FROM __h", "spectra")(
    lambda s, d: ops.continuum_removal(_s(s, d), [400.0 + 32 * k for k in range(64)]).select("vec_id", "label", F.posexplode("removed").alias("band", "removed")).withColumn("removed", F.bround(F.nanvl("removed", F.lit(None).cast("double")), 6))
)
