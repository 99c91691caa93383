"""Schemas of the measurement and neighbour tables, and the run settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names of the measurement files, in file order.
KPI_HEAD = (
    ("DATETIME", "timestamp"),
    ("CELL", "string"),
    ("CARRIER", "int"),
    ("FREQ", "double"),
    ("AZIMUTH", "int"),
    ("LAT", "double"),
    ("LON", "double"),
    ("Traffic_Volume_Gbyte", "double"),
    ("Nof_Avg_SimRRC_ConnUsr", "double"),
    ("NOF_AVG_VOLTE_USER_HWI", "double"),
    ("NUM_OF_RRC_Att", "int"),
    ("ERAB_ESTAB_ATT", "int"),
    ("AVGUL_RSSI_WEIGH_DBM_PUCCH", "double"),
    ("AVGUL_RSSI_WEIGH_DBM_PUSCH", "double"),
    ("AVG_RACH_TA", "double"),
    ("VOLTE_TRAFFIC_ERL", "double"),
    ("DLPRBUtilization", "double"),
    ("DL_PRB_Util_%_HWI", "double"),
    ("Avg_UL_RSRP_PUSCH", "double"),
    ("Avg_UL_RSRP_PUCCH", "double"),
    ("L.UL.Interference.Max", "double"),
    ("L.UL.Interference.Avg", "double"),
    ("L.UL.Interference.Min", "double"),
    ("ERAB_ATTEMPT", "int"),
    ("Average_UL_RSRP_PUSCH", "double"),
    ("AvailTime_Auto_PC_HWI", "double"),
    ("RRC_EstabSucc_PC", "double"),
    ("ERAB_Drop_PC", "double"),
    ("DL_PDCP_USER_THPUT", "double"),
    ("UL_PDCP_USER_THPUT_HWI", "double"),
    ("INTERFREQ_HO_SR", "double"),
    ("INTRAFREQ_HO_SR", "double"),
    ("ACTIVEUSER_DL_QCI1", "double"),
    ("ACTIVEUSER_UL_QCI1", "double"),
    ("Avg_CQI_HWI", "double"),
    ("AVG_MCS_PUSCH", "double"),
    ("AVG_SimRRC_ConnUsr_COUNT", "double"),
    ("E-RAB_SETUP_SUCCESS_RATE", "double"),
    ("HO_Succ_PC_In", "double"),
    ("MAC_UL_IBLER", "double"),
    ("MAC_DL_IBLER", "double"),
    ("MAC_UL_RBLER", "double"),
    ("MAC_DL_RBLER", "double"),
    ("UL_PACKET_LOSS", "double"),
    ("UL_PRB_Util_%", "double"),
)
PRB_COUNT = 100

# Fixed values: (output name, aggregate, input column) of the named 8-hour features.
# The max/min outputs are averages of the measured maximum and minimum.
NAMED_FEATURES = (
    ("avg_traffic_volume_gbyte_8h", "avg", "Traffic_Volume_Gbyte"),
    ("sum_traffic_volume_gbyte_8h", "sum", "Traffic_Volume_Gbyte"),
    ("avg_erab_drop_rate_8h", "avg", "ERAB_Drop_PC"),
    ("avg_erab_estab_attempts_8h", "avg", "ERAB_ESTAB_ATT"),
    ("avg_rrc_users_8h", "avg", "Nof_Avg_SimRRC_ConnUsr"),
    ("avg_rrc_estab_success_rate_8h", "avg", "RRC_EstabSucc_PC"),
    ("avg_rrc_attempts_8h", "avg", "NUM_OF_RRC_Att"),
    ("avg_dl_prb_utilization_8h", "avg", "DLPRBUtilization"),
    ("avg_dl_prb_util_hwi_8h", "avg", "DL_PRB_Util_%_HWI"),
    ("avg_volte_traffic_erl_8h", "avg", "VOLTE_TRAFFIC_ERL"),
    ("avg_ul_interference_8h", "avg", "L.UL.Interference.Avg"),
    ("max_ul_interference_8h", "avg", "L.UL.Interference.Max"),
    ("min_ul_interference_8h", "avg", "L.UL.Interference.Min"),
    ("avg_rssi_pucch_8h", "avg", "AVGUL_RSSI_WEIGH_DBM_PUCCH"),
    ("avg_rssi_pusch_8h", "avg", "AVGUL_RSSI_WEIGH_DBM_PUSCH"),
    ("avg_rsrp_pucch_8h", "avg", "Avg_UL_RSRP_PUCCH"),
    ("avg_rsrp_pusch_8h", "avg", "Avg_UL_RSRP_PUSCH"),
    ("avg_cqi_8h", "avg", "Avg_CQI_HWI"),
    ("avg_ho_success_rate_8h", "avg", "HO_Succ_PC_In"),
)

OVERLAP = "Overlap_Alan%"


def kpi_schema() -> T.StructType:
    """45 named measurements and one interference column per resource block."""
    kinds = {"timestamp": T.TimestampType(), "string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}
    head = [T.StructField(name, kinds[kind], True) for name, kind in KPI_HEAD]
    blocks = [T.StructField(f"L.UL.Interference.Avg.PRB{i}", T.DoubleType(), True) for i in range(PRB_COUNT)]
    return T.StructType(head + blocks)


def edge_schema() -> T.StructType:
    return T.StructType([
        T.StructField("CELL", T.StringType(), True),
        T.StructField("N_CELL", T.StringType(), True),
        T.StructField(OVERLAP, T.DoubleType(), True),
    ])


@dataclass(frozen=True)
class FeatureConfig:
    """Settings of the feature job; ``check`` compares them with a frame's columns."""

    width: str = "8 hours"
    min_overlap: float = 40.0
    variance_threshold: float = 0.0
    pca_k: int = 10
    features: tuple[str, ...] = field(default=tuple(name for name, _, _ in NAMED_FEATURES))
    skip_missing: bool = True

    def check(self, df: DataFrame) -> list[str]:
        """The configured features the frame has; the others raise unless they may be skipped."""
        missing = [f for f in self.features if f not in df.columns]
        if missing and not self.skip_missing:
            raise ValueError(f"features absent from the table: {missing}")
        return [f for f in self.features if f in df.columns]
