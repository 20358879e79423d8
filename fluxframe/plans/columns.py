"""Derived-column queries: physics, orbits, transit geometry, error propagation."""

from __future__ import annotations


from pyspark.sql import functions as F

from fluxframe.functions import constants as k
from fluxframe.functions import orbits, physics, stats
from fluxframe.functions import planets as pl
from fluxframe.plans import views
from fluxframe.plans.registry import query, rounded
from fluxframe.plans.views import sql

KEYS = "order_id, exposure_id, channel"


def num(v: float) -> str:
    return f"{float(v)!r}::DOUBLE"


@query("b1_doppler", sql("spectra_long", f"""
SELECT {KEYS}, wavelength*sqrt((1+v/{num(k.C)})/(1-v/{num(k.C)})) shifted
FROM (SELECT *, 1e7::DOUBLE*sin(exposure_id) v FROM spectra_long)""", KEYS, "shifted", 9))
def b1_doppler(spark, sf):
    df = views.spectra_long(spark, sf)
    velocity = F.lit(1e7) * F.sin("exposure_id")
    return rounded(df.select("order_id", "exposure_id", "channel", physics.doppler("wavelength", velocity).alias("shifted")), 9)


@query("b2_wavelength_frequency", sql("spectra_long", f"""
SELECT {KEYS}, {num(k.C)}/(wavelength*1e-4::DOUBLE)/1e12 thz, {num(k.C)}/(2e14::DOUBLE*wavelength)*1e4 um,
       {num(k.C)}/(3e14::DOUBLE*wavelength)*1e4 cm_e4 FROM spectra_long""", KEYS, "thz, um, cm_e4", 8))
def b2_wavelength_frequency(spark, sf):
    df = views.spectra_long(spark, sf)
    return rounded(df.select(
        "order_id", "exposure_id", "channel",
        (physics.um_to_hz("wavelength") / 1e12).alias("thz"),
        physics.hz_to_um(F.lit(2e14) * F.col("wavelength")).alias("um"),
        (physics.reciprocal_c(F.lit(3e14) * F.col("wavelength")) * 1e4).alias("cm_e4"),
    ), 8)


@query("b3_flux_cm_hz", sql("spectra_long", f"""
SELECT {KEYS}, flux*1e14*wavelength*1e-4*wavelength*1e-4/{num(k.C)} per_hz,
       flux*1e-16*(3e14*wavelength)*(3e14*wavelength)/{num(k.C)} per_cm FROM spectra_long""", KEYS, "per_hz, per_cm", 8))
def b3_flux_cm_hz(spark, sf):
    df = views.spectra_long(spark, sf)
    return rounded(df.select(
        "order_id", "exposure_id", "channel",
        physics.flux_cm_to_hz(F.col("flux") * 1e14, F.col("wavelength") * 1e-4).alias("per_hz"),
        physics.flux_hz_to_cm(F.col("flux") * 1e-16, F.col("wavelength") * 3e14).alias("per_cm"),
    ), 8)


@query("b4_irradiance_rescale", sql("spectra_long", f"""
SELECT {KEYS}, flux*power(2.5::DOUBLE/(10+channel),2) irradiance,
       flux*power(10::DOUBLE/12.5::DOUBLE,2) flux_new, uncertainty*power(10::DOUBLE/12.5::DOUBLE,2) uncertainty_new FROM spectra_long""",
    KEYS, "irradiance, flux_new, uncertainty_new", 8))
def b4_irradiance_rescale(spark, sf):
    from fluxframe.operators.score import rescale_distance

    df = views.spectra_long(spark, sf)
    moved = rescale_distance(df.withColumn("irradiance", physics.irradiance("flux", 2.5, F.col("channel") + 10)), 10.0, 12.5)
    return rounded(moved.select("order_id", "exposure_id", "channel", "irradiance",
                                F.col("flux").alias("flux_new"), F.col("uncertainty").alias("uncertainty_new")), 8)


_H, _C, _K = num(k.H), num(k.C), num(k.KB)


def _planck_hz_sql(nu: str) -> str:
    return f"(2*{_H}*power({nu},3)/power({_C},2)/(exp({_H}*({nu})/{_K}/t)-1))"


@query("b5_planck", sql("spectra_long", f"""
SELECT {KEYS}, log10(2*{_H}*power({_C},2)/power(w,5)/(exp({_H}*{_C}/w/{_K}/t)-1)) log_b_cm,
  log10({_planck_hz_sql('f')}) log_b_hz,
  log10({_planck_hz_sql('f')}/(exp({_H}*f/{_K}/t)-1)*exp({_H}*f/{_K}/t)*{_H}*f/{_K}/power(t,2)) log_db_dt,
  log10((7*{_planck_hz_sql('f')}+32*{_planck_hz_sql('f*1.0025')}+12*{_planck_hz_sql('f*1.005')}
        +32*{_planck_hz_sql('f*1.0075')}+7*{_planck_hz_sql('f*1.01')})/90) log_bin_mean
FROM (SELECT *, wavelength*1e-4 w, {_C}/(wavelength*1e-4) f, 1000+500*flux t FROM spectra_long)""",
    KEYS, "log_b_cm, log_b_hz, log_db_dt, log_bin_mean", 7))
def b5_planck(spark, sf):
    df = views.spectra_long(spark, sf).withColumn("t", F.lit(1000.0) + F.lit(500.0) * F.col("flux"))
    df = df.withColumn("f", physics.reciprocal_c(F.col("wavelength") * 1e-4))
    return rounded(df.select(
        "order_id", "exposure_id", "channel",
        F.log10(physics.planck_cm("t", F.col("wavelength") * 1e-4)).alias("log_b_cm"),
        F.log10(physics.planck_hz("t", "f")).alias("log_b_hz"),
        F.log10(physics.planck_hz_dt("t", "f")).alias("log_db_dt"),
        F.log10(physics.planck_bin_mean("t", "f", F.col("f") * 1.01)).alias("log_bin_mean"),
    ), 7)


@query("b6_scale_spectrum", sql("spectra_long", f"""
SELECT {KEYS}, flux/star emission, 1-power(0.1::DOUBLE*flux/1.2::DOUBLE,2) transmission
FROM spectra_long JOIN (SELECT order_id, channel, avg(flux) star FROM spectra_long GROUP BY ALL) USING (order_id, channel)""",
    KEYS, "emission, transmission"))
def b6_scale_spectrum(spark, sf):
    from fluxframe.operators.observe import scale_spectrum

    df = views.spectra_long(spark, sf)
    star = df.groupBy("order_id", "channel").agg(F.avg("flux").alias("star_flux"))
    both = scale_spectrum(df, "emission", star=star, on=["order_id", "channel"], out="emission")
    both = scale_spectrum(both.withColumn("r", F.col("flux") * 0.1), "transmission", star_radius=1.2, y="r", out="transmission")
    return rounded(both.select("order_id", "exposure_id", "channel", "emission", "transmission"))


@query("b7_airmass_law", sql("spectra_long", f"""
SELECT {KEYS}, CASE WHEN tr > 0 THEN exp(airmass*ln(tr)) END scaled
FROM (SELECT *, least(flux, 1.5::DOUBLE) - 0.7::DOUBLE tr FROM spectra_long)""", KEYS, "scaled"))
def b7_airmass_law(spark, sf):
    df = views.spectra_long(spark, sf).withColumn("tr", F.least("flux", F.lit(1.5)) - F.lit(0.7))
    return rounded(df.select("order_id", "exposure_id", "channel", physics.airmass_law("tr", "airmass").alias("scaled")))


@query("b8_deformation_noise", sql("spectra_long", f"""
SELECT {KEYS}, flux*(1+0.1*cos(exposure_id+channel)) + uncertainty*sin(exposure_id*7+channel) flux FROM spectra_long""", KEYS, "flux"))
def b8_deformation_noise(spark, sf):
    from fluxframe.operators.observe import apply_deformation

    df = views.spectra_long(spark, sf)
    keys = ["order_id", "exposure_id", "channel"]
    bend = df.select(*keys, (1 + F.lit(0.1) * F.cos(F.col("exposure_id") + F.col("channel"))).alias("deformation"))
    noise = df.select(*keys, (F.col("uncertainty") * F.sin(F.col("exposure_id") * 7 + F.col("channel"))).alias("noise"))
    return rounded(apply_deformation(df, bend, noise).select(*keys, "flux"))


@query("b9_orbital_phase", sql("series_long", """
SELECT series_id, x, ph phase, ph*360 longitude, ph*2*pi()/(2*pi()) phase_back FROM (
  SELECT series_id, x, raw - floor(raw) - CASE WHEN raw < 0 THEN 1 ELSE 0 END ph
  FROM (SELECT series_id, x, -3.25::DOUBLE + x/(86400*(1+0.1::DOUBLE*(series_id%50))) raw FROM series_long))""",
    "series_id", "x, phase, longitude, phase_back"))
def b9_orbital_phase(spark, sf):
    df = views.series_long(spark, sf)
    period = F.lit(k.DAY) * (1 + F.lit(0.1) * (F.col("series_id") % 50))
    df = df.withColumn("phase", orbits.orbital_phase("x", period, -3.25))
    return rounded(df.select(
        "series_id", F.col("x"), "phase", orbits.phase_to_longitude("phase").alias("longitude"),
        orbits.longitude_to_phase(orbits.phase_to_longitude("phase", degrees=False)).alias("phase_back"),
    ))


@query("b10_radial_velocity", sql("planets series_long", f"""
SELECT planet_id, x, vorb/1e5 v_orb, vorb*sin(radians(inclination))/1e5 kp,
   (vorb*sin(radians(inclination))*sin(radians(lon)) + 1e5*sin(planet_id) + 1000)/1e5 v_rel
FROM (SELECT planet_id, x, inclination, sqrt({num(k.G)}*star_mass/axis) vorb, x/(86400*period)*360 lon
      FROM planets JOIN series_long ON planet_id = series_id)""", "planet_id", "x, v_orb, kp, v_rel", 5))
def b10_radial_velocity(spark, sf):
    df = views.planets(spark, sf).join(views.series_long(spark, sf), F.col("planet_id") == F.col("series_id"))
    v = orbits.orbital_velocity("star_mass", "axis")
    df = df.withColumn("v", v).withColumn("k", orbits.semi_amplitude("v", "inclination"))
    lon = F.col("x") / (F.lit(k.DAY) * F.col("period")) * 360
    rel = orbits.relative_velocity(orbits.radial_velocity("k", lon), F.lit(1e5) * F.sin("planet_id"), 1000.0)
    return rounded(df.select("planet_id", "x", (F.col("v") / 1e5).alias("v_orb"), (F.col("k") / 1e5).alias("kp"), (rel / 1e5).alias("v_rel")), 5)


@query("b11_impact_t23", sql("planets", """
SELECT planet_id, b impact, CASE WHEN abs(b) < 1-ratio THEN 3::DOUBLE*sqrt((power(1-ratio,2)-power(b,2))/(power(1+ratio,2)-power(b,2))) END t23 FROM (
  SELECT planet_id, axis*cos(radians(inclination))/star_radius*0.05::DOUBLE b, radius/star_radius ratio FROM planets)""", "planet_id", "impact, t23"))
def b11_impact_t23(spark, sf):
    df = views.planets(spark, sf).withColumn("impact", orbits.impact_parameter("axis", "inclination", "star_radius") * 0.05)
    crosses = F.abs("impact") < 1 - F.col("radius") / F.col("star_radius")
    return rounded(df.select("planet_id", "impact", F.when(crosses, orbits.full_transit_duration(3.0, "radius", "star_radius", "impact")).alias("t23")))


@query("b12_mid_transit", sql("planets", """
SELECT planet_id, n_orbits::BIGINT n_orbits, (t - floor(t))*86400 mid_transit,
  sqrt(power(0.002::DOUBLE,2) + power(n_orbits*period*rel_upper*1e-4,2))*86400 err_upper,
  -sqrt(power(0.001::DOUBLE,2) + power(n_orbits*period*rel_lower*1e-4,2))*86400 err_lower
FROM (SELECT *, source + n_orbits*period t FROM (SELECT *, ceil((2459000.4::DOUBLE - source)/period) n_orbits FROM (
  SELECT *, 2455000.123::DOUBLE + 0.37::DOUBLE*(planet_id % 100) source FROM planets)))""",
    "planet_id, n_orbits", "mid_transit, err_upper, err_lower", 4))
def b12_mid_transit(spark, sf):
    df = views.planets(spark, sf).withColumn("source", F.lit(2455000.123) + F.lit(0.37) * (F.col("planet_id") % 100))
    rel = F.col("period") * 1e-4
    out = orbits.mid_transit(2459000.4, "source", "period", (0.001, 0.002), (rel * F.col("rel_lower"), rel * F.col("rel_upper")))
    return rounded(df.select("planet_id", *[c.alias(n) for n, c in out.items()]), 4)


def _prop_sql(*terms: str) -> str:
    return "sqrt(" + " + ".join(f"power({t},2)" for t in terms) + ")"


_AREA = f"(4*pi()*{num(k.SIGMA)}*power(r,2))"
_DERIVE = f"""
SELECT planet_id, r/{num(k.R_JUP)} radius_j, m/{num(k.M_JUP)} mass_j, teq t_eq, g gravity,
  {_prop_sql('teq*ru', '0.5::DOUBLE*teq*ru', '0.5::DOUBLE*teq*ru')} t_eq_upper,
  -{_prop_sql('teq*rl', '0.5::DOUBLE*teq*rl', '0.5::DOUBLE*teq*rl')} t_eq_lower,
  {_prop_sql('g*emu/m', '2*g*eru/r')} gravity_upper, -{_prop_sql('g*eml/m', '2*g*erl/r')} gravity_lower,
  0.39::DOUBLE*teq*exp(-power(log10(4*{num(k.SIGMA)}*power(teq,4)*1e-9)-0.14::DOUBLE,2)/1.095::DOUBLE) t_int_inflated,
  power(lum*{num(k.L_SUN)}/{_AREA},0.25) t_int,
  power(10.5::DOUBLE*1.5::DOUBLE/1e5*{num(k.G)}*power(star_mass,2)*power(r,5)/power(axis,6)
     *(sqrt({num(k.G)}*star_mass/axis)/axis)*power(0.1::DOUBLE,2)/(4*pi()*power(r,2)*{num(k.SIGMA)}),0.25) t_int_tidal
FROM (SELECT *, {num(k.G)}*m/power(r,2) g, star_teff*sqrt(star_radius/(2*axis)) teq,
   power(10::DOUBLE, -12.46::DOUBLE + 1.74::DOUBLE*log10(m/{num(k.M_EARTH)}) - 0.94::DOUBLE*log10(r/{num(k.R_JUP)})
     - 1.04::DOUBLE*log10(star_age/{num(1e9 * k.YEAR)})) lum
  FROM (SELECT *, rel_upper ru, rel_lower rl,
    coalesce(radius, power(3*mass/(4*pi()*density), 1/3::DOUBLE)) r, coalesce(mass, density*4/3::DOUBLE*pi()*power(radius,3)) m,
    CASE WHEN radius IS NOT NULL THEN radius*rel_upper ELSE {_prop_sql("rr/3*rel_upper", "rr/3*rel_upper")} END eru,
    CASE WHEN radius IS NOT NULL THEN abs(radius*rel_lower) ELSE {_prop_sql("rr/3*rel_lower", "rr/3*rel_lower")} END erl,
    CASE WHEN mass IS NOT NULL THEN mass*rel_upper ELSE {_prop_sql("mm*rel_upper", "3*mm*rel_upper")} END emu,
    CASE WHEN mass IS NOT NULL THEN abs(mass*rel_lower) ELSE {_prop_sql("mm*rel_lower", "3*mm*rel_lower")} END eml
    FROM (SELECT *, power(3*mass/(4*pi()*density), 1/3::DOUBLE) rr, density*4/3::DOUBLE*pi()*power(radius,3) mm FROM planets)))
"""


@query("b13_derived_catalog", sql("planets", _DERIVE, "planet_id",
    "radius_j, mass_j, t_eq, gravity, t_eq_upper, t_eq_lower, gravity_upper, gravity_lower, t_int_inflated, t_int, t_int_tidal", 5))
def b13_derived_catalog(spark, sf):
    from fluxframe.operators.catalog import derive_catalog

    df = views.planets(spark, sf)
    for name in ("mass", "radius", "density", "axis", "star_radius", "star_teff", "star_age"):
        df = df.withColumn(f"{name}_upper", F.col(name) * F.col("rel_upper")).withColumn(f"{name}_lower", F.col(name) * F.col("rel_lower"))
    got = derive_catalog(df)
    tidal = pl.intrinsic_temperature_tidal(1e5, "radius", "axis", orbits.orbital_velocity("star_mass", "axis"), 0.1, "star_mass")
    return rounded(got.select(
        "planet_id", (F.col("radius") / k.R_JUP).alias("radius_j"), (F.col("mass") / k.M_JUP).alias("mass_j"),
        "t_eq", "t_eq_upper", "t_eq_lower", "gravity", "gravity_upper", "gravity_lower",
        "t_int", "t_int_inflated", tidal.alias("t_int_tidal"),
    ), 5)


@query("b13_gravity_conversions", sql("planets", f"""
SELECT planet_id, rg/{num(k.R_SUN)} r_from_g, mg/{num(k.M_SUN)} m_from_g,
  {_prop_sql('rg/2*rel_upper', 'rg/2*rel_upper')}/{num(k.R_SUN)} r_upper, -{_prop_sql('mg*rel_lower', '2*mg*rel_lower')}/{num(k.M_SUN)} m_lower
FROM (SELECT *, sqrt({num(k.G)}*star_mass/lg) rg, lg/{num(k.G)}*power(star_radius,2) mg
  FROM (SELECT *, 1e4::DOUBLE*(1+planet_id%9) lg FROM planets))""", "planet_id", "r_from_g, m_from_g, r_upper, m_lower"))
def b13_gravity_conversions(spark, sf):
    df = views.planets(spark, sf).withColumn("lg", F.lit(1e4) * (1 + F.col("planet_id") % 9))

    def err(c):
        return (F.col(c) * F.col("rel_upper"), F.col(c) * F.col("rel_lower"))

    r, r_up, _ = pl.radius_from_gravity("lg", "star_mass", err("lg"), err("star_mass"))
    m, _, m_low = pl.mass_from_gravity("lg", "star_radius", err("lg"), err("star_radius"))
    return rounded(df.select("planet_id", (r / k.R_SUN).alias("r_from_g"), (m / k.M_SUN).alias("m_from_g"),
                             (r_up / k.R_SUN).alias("r_upper"), (m_low / k.M_SUN).alias("m_lower")))


@query("b13_intrinsic_temperature_errors", None)
def b13_intrinsic_temperature_errors(spark, sf):
    df = views.planets(spark, sf)

    def err(c):
        return (F.col(c) * F.col("rel_upper"), F.col(c) * F.col("rel_lower"))

    t, up, low = pl.intrinsic_temperature("mass", "radius", "star_age", err("mass"), err("radius"), err("star_age"))
    return rounded(df.select("planet_id", t.alias("t_int"), up.alias("t_int_upper"), low.alias("t_int_lower")), 4)


@query("b14_error_propagation", sql("measurements", """
SELECT entity_id, parameter, value, sqrt(power(2*u,2)+power(3*l,2)) plain,
  sqrt(power(2*u,2)+power(3*l,2)+2*0.5::DOUBLE*2*abs(u)*3*abs(l)) correlated FROM (
  SELECT entity_id, parameter, value, err_upper u, err_lower l FROM measurements)""", "entity_id, parameter, value", "plain, correlated", 8))
def b14_error_propagation(spark, sf):
    df = views.measurements(spark, sf)
    d, s = [2.0, 3.0], ["err_upper", "err_lower"]
    return rounded(df.select(
        "entity_id", "parameter", "value", stats.propagate(d, s).alias("plain"),
        stats.propagate(d, s, [[1.0, 0.5], [0.5, 1.0]]).alias("correlated"),
    ), 8)


@query("b15_light_loss", sql("spectra_long", f"""
SELECT {KEYS}, z distance, CASE WHEN z <= p-1 THEN 0 WHEN z <= 1-p THEN 1-p*p
  WHEN z < 1+p AND z > abs(1-p) THEN 1-(p*p*acos((p*p+z*z-1)/(2*p*z)) + acos((1-p*p+z*z)/(2*z))
     - sqrt((4*z*z-power(1+z*z-p*p,2))/4))/pi() ELSE 1 END flux
FROM (SELECT *, sqrt(power(0.2::DOUBLE,2) + (power(1+p,2)-power(0.2::DOUBLE,2))*power(lon/degrees(0.1::DOUBLE/2.5::DOUBLE*pi()),2)) z
  FROM (SELECT *, sqrt(0.02::DOUBLE + 0.005::DOUBLE*flux) p, -10 + 20*((exposure_id*37)%501)/501::DOUBLE lon FROM spectra_long))""",
    KEYS, "distance, flux"))
def b15_light_loss(spark, sf):
    from fluxframe.operators.observe import apply_light_loss

    df = views.spectra_long(spark, sf)
    df = df.withColumn("flux", 1 - (F.lit(0.02) + F.lit(0.005) * F.col("flux")))
    df = df.withColumn("longitude", F.lit(-10.0) + 20 * ((F.col("exposure_id") * 37) % 501) / F.lit(501.0))
    got = apply_light_loss(df, impact=0.2, longitude="longitude", duration=0.1, period=2.5, keep_distance="distance")
    return rounded(got.select("order_id", "exposure_id", "channel", "distance", "flux"))


@query("b18_loglik_to_chi2", sql("loglik_long", "SELECT dataset, sample_id, point_id, -2*log_lik chi2 FROM loglik_long",
    "dataset, sample_id, point_id", "chi2"))
def b18_loglik_to_chi2(spark, sf):
    df = views.loglik_long(spark, sf)
    return rounded(df.select("dataset", "sample_id", "point_id", stats.loglik_to_chi2("log_lik").alias("chi2")))


@query("b20_scaled_metallicity", sql("planets", f"""
SELECT planet_id, 7.2::DOUBLE*power(mass/{num(k.M_JUP)},-0.68::DOUBLE)*0.8::DOUBLE metallicity FROM planets""",
    "planet_id", "metallicity"))
def b20_scaled_metallicity(spark, sf):
    df = views.planets(spark, sf)
    return rounded(df.select("planet_id", physics.scaled_metallicity("mass", mixing=0.8).alias("metallicity")))


@query("b21_black_body_disk", sql("spectra_long", f"""
SELECT {KEYS}, flux + 2*{_H}*power({_C},2)/power(wavelength*1e-4,5)/(exp({_H}*{_C}/(wavelength*1e-4)/{_K}/1500)-1)
  *1e-7*power(2::DOUBLE/1000,2) flux FROM spectra_long""", KEYS, "flux"))
def b21_black_body_disk(spark, sf):
    df = views.spectra_long(spark, sf)
    return rounded(df.select("order_id", "exposure_id", "channel", physics.black_body_disk("flux", 1500.0, "wavelength", 2.0, 1000.0).alias("flux")))


@query("a8_jansky", sql("spectra_long", f"""
SELECT {KEYS}, 1e-26*2.99792458e14*flux*1e12/power(wavelength,2) flux, 1e-26*2.99792458e14*uncertainty*1e12/power(wavelength,2) uncertainty
FROM spectra_long""", KEYS, "flux, uncertainty", 8))
def a8_jansky(spark, sf):
    df = views.spectra_long(spark, sf)
    return rounded(df.select("order_id", "exposure_id", "channel",
                             physics.jansky_to_flux(F.col("flux") * 1e12, "wavelength").alias("flux"),
                             physics.jansky_to_flux(F.col("uncertainty") * 1e12, "wavelength").alias("uncertainty")), 8)


