"""Fixed values of tracking and display, shared by the streams and the replays."""

from __future__ import annotations

import numpy as np

SIZE = ("x", "y", "width", "height")
VELOCITY = ("vx", "vy", "vwidth", "vheight")

# Fixed values of tracking.
MAX_GAP = 0.85
KEEP_CONFIDENCE, DECAY = 0.12, 0.94
TRACK_REACH = (0.16, 0.22)
TRACK_WEIGHTS = {"iou": 5.0, "distance": -1.2, "growth": -0.2, "motion": 0.9}
TRACK_BONUS = (4.0, 2.0)
MOTION_CAP = 0.28  # the most that motion adds to a score
LEAST_OVERLAP, DOUBTFUL_OVERLAP, MOST_GROWTH = 0.04, 0.08, 3.0
# A track that nothing continues ends this many seconds after its last detection.
UNSEEN = 1.4

# Fixed values of display smoothing.
HOLD, HOLD_IDENTIFIED = 1.4, 1.8
PAD = (0.01, 0.08)
LAG, LEAD = (0.05, 0.08), (0.18, 0.28)
TOP_SPEED, TOP_SIZE_SPEED = (1.45, 1.8), 1.3
VELOCITY_BLEND, SMOOTH = 0.58, 0.34
SHOW_WEIGHTS = {"iou": 5.2, "distance": -1.35, "change": -0.35, "confidence": 0.15}
SHOW_REACH = (0.15, 0.18)
SHOW_REACH_KEYED, SHOW_BONUS_KEYED = 0.34, 10.0
SLOWING = np.array([0.86, 0.86, 0.82, 0.82])
#: For identified faces and for all else: still, moving; then bounds of distance and of size change for both.
SHIFT = np.array([[0.28, 0.82, 0.035, 0.18, 0.18, 0.45], [0.22, 0.72, 0.028, 0.16, 0.16, 0.5]])
