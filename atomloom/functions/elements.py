"""Atomic numbers and masses by element symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TABLE = (
    "Ac:89:227 Ag:47:107.868 Al:13:26.982 Am:95:243 Ar:18:39.948 As:33:74.922 At:85:210 Au:79:196.967 "
    "B:5:10.811 Ba:56:137.327 Be:4:9.012 Bh:107:272 Bi:83:208.98 Bk:97:247 Br:35:79.904 C:6:12.011 "
    "Ca:20:40.078 Cd:48:112.411 Ce:58:140.116 Cf:98:251 Cl:17:35.453 Cm:96:247 Cn:112:285 Co:27:58.933 "
    "Cr:24:51.996 Cs:55:132.905 Cu:29:63.546 Db:105:268 Ds:110:281 Dy:66:162.5 Er:68:167.259 Es:99:252 "
    "Eu:63:151.984 F:9:18.998 Fe:26:55.845 Fl:114:289 Fm:100:257 Fr:87:223 Ga:31:69.723 Gd:64:157.25 "
    "Ge:32:72.64 H:1:1.008 He:2:4.002 Hf:72:178.49 Hg:80:200.592 Ho:67:164.93 Hs:108:270 I:53:126.904 "
    "In:49:114.818 Ir:77:192.217 K:19:39.098 Kr:36:83.798 La:57:138.905 Li:3:6.941 Lr:103:262 Lu:71:174.967 "
    "Lv:116:293 Mc:115:288 Md:101:258 Mg:12:24.305 Mn:25:54.938 Mo:42:95.96 Mt:109:276 N:7:14.007 "
    "Na:11:22.99 Nb:41:92.906 Nd:60:144.242 Ne:10:20.18 Nh:113:284 Ni:28:58.693 No:102:259 Np:93:237 "
    "O:8:15.999 Og:118:294 Os:76:190.23 P:15:30.974 Pa:91:231.036 Pb:82:207.2 Pd:46:106.42 Pm:61:145 "
    "Po:84:209 Pr:59:140.908 Pt:78:195.085 Pu:94:244 Ra:88:226 Rb:37:85.468 Re:75:186.207 Rf:104:267 "
    "Rg:111:280 Rh:45:102.906 Rn:86:222 Ru:44:101.07 S:16:32.065 Sb:51:121.76 Sc:21:44.956 Se:34:78.96 "
    "Sg:106:271 Si:14:28.085 Sm:62:150.36 Sn:50:118.71 Sr:38:87.62 Ta:73:180.948 Tb:65:158.925 Tc:43:98 "
    "Te:52:127.6 Th:90:232.038 Ti:22:47.867 Tl:81:204.383 Tm:69:168.934 Ts:117:294 U:92:238.029 V:23:50.942 "
    "W:74:183.84 Xe:54:131.293 Y:39:88.906 Yb:70:173.045 Zn:30:65.39 Zr:40:91.224 "
)
_ROWS = [x.split(":") for x in _TABLE.split()]
NUMBER: dict[str, int] = {s: int(z) for s, z, _ in _ROWS}
SYMBOL: dict[int, str] = {z: s for s, z in NUMBER.items()}
MASS: dict[str, float] = {s: float(m) for s, _, m in _ROWS}


def element_table(spark: SparkSession) -> DataFrame:
    """(species, z, mass): a dimension of about a hundred rows."""
    return spark.createDataFrame([(s, z, MASS[s]) for s, z in sorted(NUMBER.items())], "species string, z int, mass double")


def number_of(species: Column) -> Column:
    """Atomic number of a symbol column; null if unknown."""
    return F.create_map(*[F.lit(v) for kv in NUMBER.items() for v in kv])[species]


def symbol_of(number: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in SYMBOL.items() for v in kv])[number.cast("int")]
