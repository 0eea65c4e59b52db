"""Physical constants and selection tables. Results depend on exactly these."""

GAMMA = 5 / 3
K_B = 1.3807e-16  # erg/K
M_P = 1.6726e-24  # g
UNIT_C = 1.0e10
X_H = 0.76
SIGMA_T = 6.6524587158e-29 * 1.0e2**2  # cm^2
M_E = 9.10938356e-28  # g
C = 29979245800.0  # cm/s
SOLAR_MASS = 1.989e33  # g
KPC_CM = 3.0856775814913674e21
MPC_CM = 1.0e3 * KPC_CM
T_CMB = 2.7255  # K
MU_E_KSZ = 1.14
#: (km/s)/(m/s) of the optical depth to microkelvin conversion.
V_OVER_C = 300000 / 299792458

#: Halo mass bins in Msun/h.
MASS_BINS = {0: (5e11, 1e12), 1: (1e12, 1e13), 2: (1e13, 1e19), 3: (1e14, 1e19)}
#: Closed-open bins of the power-spectrum runs share the edges; -1 has all.
DEFAULT_OMEGA_BARYON = {"A": 0.0456, "B": 0.048, "C": 0.0486}
TARGET_MASS, UPPER_MASS, ABUNDANCE = 10**13.22, 5 * 10**14, 0.0005
