"""Fixed values of the screening rules; every operator takes them as arguments."""

#: Pauses and long pauses, seconds.
PAUSE_SEC, LONG_PAUSE_SEC = 2.5, 5.0
#: Rates in beats per minute by weight class.
BRADY_BPM = {"small": 60.0, "medium": 50.0, "large": 45.0}
TACHY_BPM = {"small": 180.0, "medium": 160.0, "large": 150.0}
SUSTAINED_BEATS = 3
#: Labelling against the last beats labelled normal.
BASELINE_BEATS, WIDE_RATIO, WIDE_MARGIN_SEC, PREMATURE_RATIO, LATE_RATIO = 8, 1.25, 0.030, 0.85, 1.5
#: Signal quality.
WINDOW_SEC, FLAT_SHARE, TONE_RATIO, HIGH_RATIO, LOW_RATIO = 5.0, 0.9, 3.0, 4.0, 0.1
PAD_SEC, MERGE_SEC, EDGE_SEC = 2.0, 30.0, 60.0
#: Published bands.
MIN_HOURS = 20.0
#: Off-body tail: least run and share of windows with the lead off; good gap that ends the walk back.
TAIL_WINDOWS, TAIL_SHARE, REMOVAL_WINDOWS = 360, 0.9, 60
#: Strips: width, margin around a marked span, most strips of a section and of the hours.
STRIP_SEC, STRIP_MARGIN_SEC, MAX_STRIPS, MAX_HOUR_STRIPS = 6.0, 1.0, 24, 48
#: Tolerance of a detection.
MATCH_SEC = 0.15
#: Frames of a waveform and what they see of their neighbours.
FRAME_SEC, HALO_SEC = 300.0, 15.0
#: Bursts of steepness: smoothing, average and ratio to it, least share of the mean length, distance.
SMOOTH_SEC, AVERAGE_SEC, BURST_RATIO, BURST_LENGTH, DELAY_SEC = 0.1, 0.75, 1.5, 0.4, 0.3
#: Place of a peak without a maximum; amplitude around a peak and its least share of the median.
FIDUCIAL_SEC, BASELINE_SEC, AMPLITUDE_SEC, LEAST_AMPLITUDE = 0.05, 0.2, 0.15, 0.2
#: Gaps in a fast rhythm and what fills them.
FAST_RR_SEC, GAP_RATIO, FILL_SHARE, FILL_SEC = 0.8, 1.5, 0.35, 0.25
#: T waves in a slow rhythm.
SLOW_RR_SEC, COUPLING_SEC, T_WAVE_SHARE = 0.6, 0.45, 0.25
#: Width of a QRS: smoothing of its energy, share of the peak, multiple of the noise.
ENERGY_SEC, WIDTH_SHARE, NOISE_RATIO = 0.03, 0.1, 4.0
#: Least width of a span in a timeline's lane; most beats of a strip that prints every interval.
LANE_SEC, SPARSE_BEATS = 5.0, 8
