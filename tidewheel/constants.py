"""Fixed values every operator shares: band edges, thresholds, tolerances, search ranges."""

# Frequency bands in Hz.
BANDS = {
    "bass": (20.0, 150.0),
    "lowmid": (150.0, 400.0),
    "mid": (400.0, 2000.0),
    "high": (2000.0, 6000.0),
    "air": (6000.0, 16000.0),
}
FLUX_BANDS = {"flux": (20.0, 16000.0), "bflux": (20.0, 150.0), "hflux": (2000.0, 16000.0)}
VOCAL_BAND = (250.0, 3500.0)
COMPARED_VOCAL_BAND = (350.0, 3400.0)
CHROMA_BAND = (27.5, 1000.0)
TEMPO_FLUX_BAND = (30.0, 16000.0)
ALIGN_RANGE = (40.0, 16000.0)
ALIGN_BANDS_PER_OCTAVE = 6

# Framing and levels.
FPS = 100
SAMPLE_RATE = 48000
WINDOW = 2048
FLOOR_DB = -100.0
FLUX_CEILING = 1.5
CENTROID_SCALE_HZ = 8000.0
VOCAL_CONTRAST_LIMIT_DB = 30.0
DUAL_MONO_DB = -60.0
NORMALISE_LOW = 0.05
NORMALISE_HIGH = 0.995
PACK_FORMAT = "songpack/1"

# Tempo and grid.
TOLERANCE_S = 1.0 / 48.0
BPM_RANGE = (60.0, 200.0)
PRIOR_BPM = 120.0
PRIOR_OCTAVES = 1.0
COMB_SPAN = 0.015
TEMPO_CANDIDATES = 4
DOUBLE_EVIDENCE = 0.85
OCTAVE_CLOSE = 0.9
PULSE_CONTRAST = 4.0
DOWNBEAT_BLOCK_BARS = 4
DOWNBEAT_SURE = 0.6
SECTION_BARS = 8
LOUDEST_SECONDS = 60

# Comparing two versions.
COMPARE_WINDOW_S = 8.0
COMPARE_STEP_S = 4.0
COMPARE_SEARCH_S = 1.5
GLOBAL_SEARCH_S = 20.0
AGREE_S = 0.02
TIE_R = 0.002
FLAT_DB = 1.0
MIN_MATCH_R = 0.3
DELTA_THRESHOLD = 0.15
SHAPE_THRESHOLD = 0.75
RHYTHM_THRESHOLD = 0.8
NEW_VOICE_THRESHOLD = 0.10
NEW_VOICE_ON = 0.35
NEW_VOICE_OFF = 0.15
SAME_R = 0.65
AUDIBLE_DB = 50.0
STRETCH_R = 0.8
STRETCH_GAIN = 0.05
ONSETS_ALIGNED = 0.4
ONSETS_STRETCHED = 0.6
VOCAL_MOVED_R = 0.8
VOCAL_MOVED_GAIN = 0.2
SHAPE_ACTIVITY = 0.03
RHYTHM_ACTIVITY = 0.2
HEAD_MARGIN_S = 0.25
FINE_SEGMENT = 1 << 17
FINE_REACH_S = 0.03
FINE_SPREAD_S = 0.001
EXIT_CODES = {"remux": 0, "rerender": 3, "new grid": 4, "offset": 5}

# Aligning notes and stems.
ALIGN_SEARCH_S = 30.0
ALIGN_MIN_R = 0.25
ALIGN_MIN_MARGIN = 0.05
STEM_SEARCH_S = 2.0
STEM_MIN_R = 0.2
STEM_MIN_MARGIN = 0.05
STEM_TOLERANCE_S = 0.5
VOICES = ("vocals", "vocal", "vox", "voice")
RUNNER_UP_S = 0.05
DRUM_WEIGHT = 2.0
ONSET_CLUSTER_S = 0.020
CHORD_CLUSTER_S = 0.030
POLYPHONIC_SHARE = 0.2
EDGE_S = 0.001
DEFAULT_TEMPO_US = 500000
DRUM_CHANNEL = 9

# Delivery.
CEILING_DBTP = -1.0
LOUD_CEILING_DBTP = -2.0
NORMALISED_LUFS = -14.0
LIMITER_FLOOR_DBFS = -24.0
NEAR_SILENT_DBFS = -60.0
ASPECT_TOLERANCE = 0.01
TIME_SLACK_S = 1e-3
FPS_SLACK = 0.01

# Beats between cuts, per density name (static sections are one cut).
BEATS_PER_CUT = {
    "every_beat": 1,
    "every_2_beats": 2,
    "every_4_beats": 4,
    "every_bar": 4,
    "every_2_bars": 8,
    "every_4_bars": 16,
    "static": None,
}
EFFECTS = (
    "kaleidoscope", "strobe", "invert_flash", "freeze_on_peak", "grain", "scanlines",
    "halation", "vignette", "zoom_breathe", "static_noise",
)

# Frames per block when a series is split for distribution: one block is one unit of window
# work, so no task ever holds a whole long series.
BLOCK = 16384
