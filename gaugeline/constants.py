"""Closed vocabularies and tables of the drawing model, as plain values."""

from __future__ import annotations

# Vocabularies of the drawing schema.
KINDS = ("dimension", "geometric_tolerance", "note", "surface_finish", "thread")
DIM_TYPES = ("linear", "diameter", "radius", "angular", "chamfer", "thread")
TOL_STYLES = ("bilateral", "unilateral", "limit", "fit", "general", "basic")
MODIFIERS = ("MMC", "LMC")
DATUM_TYPES = ("planar_face", "cylindrical_feature", "axis", "width", "spherical")
SYMBOLS = ("flatness", "straightness", "circularity", "cylindricity", "perpendicularity", "parallelism", "angularity", "position", "concentricity", "symmetry", "circular_runout", "total_runout", "profile_surface")
FORM_SYMBOLS = ("flatness", "straightness", "circularity", "cylindricity")
DATUM_REQUIRED = ("position", "perpendicularity", "parallelism", "angularity", "concentricity", "symmetry", "circular_runout", "total_runout")
NO_MODIFIER = (*FORM_SYMBOLS, "profile_surface", "circular_runout", "total_runout")
SIZED_DATUMS = ("cylindrical_feature", "axis", "width", "spherical")
AXIAL_DATUMS = ("cylindrical_feature", "axis")
ORIENTING = ("perpendicularity", "parallelism", "angularity")
LOCATING = ("position", "concentricity", "symmetry", "profile_surface")
RUNOUT = ("circular_runout", "total_runout")

# Degrees of freedom that a datum removes as primary, secondary, tertiary.
DOF = {"planar_face": (3, 2, 1), "cylindrical_feature": (4, 2, 1), "axis": (4, 2, 1), "width": (3, 2, 1), "spherical": (3, 1, 1)}

# Cost of each error, and what a critical characteristic multiplies it by.
ERROR_COSTS = {"missed_characteristic": 3.0, "spurious_characteristic": 1.0, "wrong_nominal": 1.0, "wrong_tolerance": 1.5, "wrong_symbol": 2.0, "wrong_modifier": 2.0, "wrong_datum_refs": 2.5, "schema_violation": 1.0}
CRITICAL = 4.0

# Coarse pitches of the ISO metric thread series by diameter.
COARSE_PITCH = {1.6: 0.35, 2.0: 0.4, 2.5: 0.45, 3.0: 0.5, 4.0: 0.7, 5.0: 0.8, 6.0: 1.0, 8.0: 1.25, 10.0: 1.5, 12.0: 1.75, 14.0: 2.0, 16.0: 2.0, 18.0: 2.5, 20.0: 2.5, 22.0: 2.5, 24.0: 3.0, 27.0: 3.0, 30.0: 3.5, 33.0: 3.5, 36.0: 4.0, 39.0: 4.0, 42.0: 4.5, 45.0: 4.5, 48.0: 5.0, 52.0: 5.0, 56.0: 5.5, 60.0: 5.5, 64.0: 6.0}

MM_PER_INCH = 25.4
