"""Physical constants in CGS (CODATA, IAU nominal values)."""

C = 2.99792458e10
H = 6.62607015e-27
KB = 1.380649e-16
G = 6.6743e-8
SIGMA = 5.670374419e-5
AMU = 1.6605390666e-24

DAY = 86400.0
HOUR = 3600.0
YEAR = 31536000.0

AU = 1.495978707e13
PC = 3.085677581491367e18
R_SUN = 6.957e10
R_JUP = 7.1492e9
M_SUN = 1.988409870698051e33
M_JUP = 1.8981245973360505e30
M_EARTH = 5.972167867791379e27
L_SUN = 3.828e33
S_EARTH = 1.3654e6

# An invalid model scores this; smaller magnitudes than TINY_LOG_L are lifted to it.
WORST_LOG_L = -1e99
TINY_LOG_L = 1e-99
