"""The feature specification, labels, word lists and texts that results depend on."""

# Name, path in a report's chunk, transform, group; the order breaks ties.
FEATURES = [
    ("wer_score", "audio_visual_consistency.transcripts.wer_score", "identity", "content_consistency"),
    ("semantic_anomaly", "audio_visual_consistency.semantic_consistency.percentile_3rd_cosine", "one_minus", "semantic_consistency"),
    ("min_cosine_anomaly", "audio_visual_consistency.semantic_consistency.min_cosine_similarity", "one_minus", "semantic_consistency"),
    ("temporal_anomaly", "audio_visual_consistency.temporal_sync.sync_score", "one_minus", "temporal_sync"),
    ("min_temporal_anomaly", "audio_visual_consistency.temporal_sync.min_sync_score", "one_minus", "temporal_sync"),
    ("temporal_sync_variance", "audio_visual_consistency.temporal_sync.variance", "identity", "temporal_sync"),
    ("max_blur_flicker", "visual_spatial.blur.max_blur_flicker", "identity", "visual_spatial"),
    ("blur_flicker_variance", "visual_spatial.blur.blur_flicker_variance", "identity", "visual_spatial"),
    ("max_texture_flicker", "visual_spatial.texture.max_texture_flicker", "identity", "visual_spatial"),
    ("asymmetry_max", "visual_spatial.texture.asymmetry_max", "identity", "visual_spatial"),
    ("mean_landmark_jitter", "visual_spatial.kinematics.mean_landmark_jitter", "identity", "visual_spatial"),
    ("max_kinematic_flicker", "visual_spatial.kinematics.max_kinematic_flicker", "identity", "visual_spatial"),
    ("max_rigid_violation", "visual_spatial.kinematics.max_rigid_violation", "identity", "visual_spatial"),
    ("blinking_variance", "visual_spatial.kinematics.blinking_variance", "identity", "visual_spatial"),
    ("mouth_movement_variance", "visual_spatial.kinematics.mouth_movement_variance", "identity", "visual_spatial"),
    ("gaze_anomaly", "visual_spatial.eye_gaze.gaze_pose_sync_score", "one_minus", "visual_spatial"),
    ("iris_jitter_variance", "visual_spatial.iris_jitter.iris_jitter_variance", "identity", "visual_spatial"),
    ("max_blending_flicker", "visual_spatial.blending.max_blending_flicker", "identity", "visual_spatial"),
    ("blending_variance", "visual_spatial.blending.blending_variance", "identity", "visual_spatial"),
    ("vocal_jitter_relative", "audio_artifacts.vocal_jitter_relative", "identity", "audio_artifacts"),
    ("vocal_shimmer_relative", "audio_artifacts.vocal_shimmer_relative", "identity", "audio_artifacts"),
]

# What a feature is called in an interpretation.
LABELS = {
    "wer_score": "content mismatch between ASR and VSR transcripts",
    "semantic_anomaly": "drop in audio-visual semantic consistency (3rd percentile)",
    "min_cosine_anomaly": "drop in semantic consistency at the weakest point",
    "temporal_anomaly": "drop in audio-visual temporal synchronization",
    "min_temporal_anomaly": "weakest temporal sync score within the chunk",
    "temporal_sync_variance": "variance of temporal synchronization within the chunk",
    "max_blur_flicker": "frame-to-frame blur flicker",
    "blur_flicker_variance": "variance of blur flicker",
    "max_texture_flicker": "surface texture flicker",
    "asymmetry_max": "facial texture asymmetry",
    "mean_landmark_jitter": "average facial landmark jitter",
    "max_kinematic_flicker": "facial geometry flicker",
    "max_rigid_violation": "rigid motion violation of facial landmarks",
    "blinking_variance": "variance in blinking frequency",
    "mouth_movement_variance": "variance in mouth movement",
    "gaze_anomaly": "inconsistency between gaze direction and head pose",
    "iris_jitter_variance": "abnormal iris region jitter",
    "max_blending_flicker": "face-blending artifact flicker",
    "blending_variance": "variance of face-blending artifacts",
    "vocal_jitter_relative": "micro-fluctuation in vocal pitch (jitter)",
    "vocal_shimmer_relative": "micro-fluctuation in vocal amplitude (shimmer)",
}

# The glossary's groups, in prompt order.
GLOSSARY = {
    "GROUP 1 — VISUAL ARTIFACTS": {
        "max_blur_flicker": "frame-to-frame sharpness flicker; high -> synthesized/blended region",
        "blur_flicker_variance": "blur flicker instability; high -> intermittent blending artifacts",
        "max_texture_flicker": "skin-texture flicker; high -> generated texture inconsistent across frames",
        "asymmetry_max": "left-right facial texture asymmetry; high -> imperfect face blending",
        "max_blending_flicker": "face-blend boundary flicker; high -> visible compositing seam",
        "blending_variance": "blending artifact instability; high -> ongoing compositing seam",
    },
    "GROUP 2 — FACIAL DYNAMICS": {
        "mean_landmark_jitter": "average landmark instability; high -> jittery non-physical facial motion",
        "max_kinematic_flicker": "facial-geometry flicker; high -> geometry snapping between frames",
        "max_rigid_violation": "rigid motion violation; high -> face parts moving independently of head",
        "blinking_variance": "blink activity variance; LOW -> absent blinking (synthesis giveaway)",
        "mouth_movement_variance": "mouth movement variance; LOW -> static mouth during speech (poor lip-sync)",
        "gaze_anomaly": "gaze-pose mismatch; high -> eyes not tracking naturally with head",
        "iris_jitter_variance": "iris position variance; LOW -> unnaturally still eyes (dead eye)",
    },
    "GROUP 3 — AUDIO-VISUAL COHERENCE": {
        "wer_score": "ASR vs VSR disagreement; high -> audio doesn't match lip motion",
        "semantic_anomaly": "audio-visual semantic drop; high -> speech meaning misaligns with face",
        "min_cosine_anomaly": "worst-point semantic mismatch; high -> clear mismatch moment",
        "temporal_anomaly": "audio-visual temporal desync; high -> lips and sound out of phase",
        "min_temporal_anomaly": "worst-point temporal desync; high -> clear out-of-sync moment",
        "temporal_sync_variance": "sync quality fluctuation; high -> unstable lip-sync",
    },
    "GROUP 4 — AUDIO ARTIFACTS": {
        "vocal_jitter_relative": "vocal pitch micro-fluctuation; LOW -> too-perfect pitch (TTS/voice-cloning)",
        "vocal_shimmer_relative": "vocal amplitude micro-fluctuation; LOW -> too-perfect amplitude (synthetic voice)",
    },
}

# Features that are suspicious when low.
LOW_IS_SUSPICIOUS = ["vocal_jitter_relative", "vocal_shimmer_relative", "blinking_variance", "mouth_movement_variance", "iris_jitter_variance"]

# Contractions and what they stand for.
CONTRACTIONS = {
    "it's": "it is", "don't": "do not", "doesn't": "does not", "can't": "cannot", "i'm": "i am", "that's": "that is", "i've": "i have", "you've": "you have",
    "we've": "we have", "they've": "they have", "you're": "you are", "we're": "we are", "they're": "they are", "isn't": "is not", "aren't": "are not",
    "wasn't": "was not", "weren't": "were not", "won't": "will not", "wouldn't": "would not", "couldn't": "could not", "shouldn't": "should not",
    "hasn't": "has not", "haven't": "have not", "hadn't": "had not", "i'll": "i will", "you'll": "you will", "he'll": "he will", "she'll": "she will",
    "we'll": "we will", "they'll": "they will", "i'd": "i would", "you'd": "you would", "he'd": "he would", "she'd": "she would", "he's": "he is",
    "she's": "she is", "there's": "there is", "let's": "let us", "what's": "what is", "who's": "who is", "where's": "where is", "how's": "how is", "y'all": "you all",
}

# Spoken fillers, and words that a cut-off transcript may end in.
FILLERS = ["um", "uh", "ah", "er", "hmm", "mhmm", "huh"]
TAIL_WORDS = ["and", "or", "but", "so", "because", "that", "to", "of", "for", "in", "on", "with", "a", "an", "the"]

# Signal bounds of a percentile rank, in the order in which they are tried.
SIGNALS = [(">=", 95, "FAR_ABOVE_NORMAL"), (">=", 80, "ABOVE_NORMAL"), ("<=", 5, "FAR_BELOW_NORMAL"), ("<=", 20, "BELOW_NORMAL")]

# Defaults of the stages.
CHUNK_SEC, STRIDE_SEC, MIN_CHUNK_SEC, SLIDE_SEC, FPS = 4.0, 2.0, 1.0, 0.5, 25.0
TOP_CHUNKS, FRAMES_PER_CHUNK, TOP_FEATURES = 5, 4, 5
HIDDEN, LATENT, BETA, THRESHOLD_PERCENTILE = (64, 32), 8, 1.0, 0.95

# The sentences of an interpretation by level.
NO_FEATURE = "This chunk was scored by the anomaly model, but no observed feature could be identified as a main contributor."
LEVEL_TEXT = {
    "high": "This chunk exceeds the genuine baseline threshold and is considered highly anomalous. The main contributing features are: ",
    "medium": "This chunk shows a moderate deviation from the genuine baseline. The largest reconstruction errors are associated with: ",
    "low": "This chunk has a low anomaly score. The listed features are the largest reconstruction-error contributors within this chunk, but they do not necessarily indicate a strong anomaly: ",
}

VISUAL = [name for name, _, _, group in FEATURES if group == "visual_spatial"]
AUDIO = [name for name, _, _, group in FEATURES if group != "visual_spatial"]
