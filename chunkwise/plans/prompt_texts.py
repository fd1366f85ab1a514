"""The texts of the reasoning model's prompt."""

from chunkwise.spec import GLOSSARY

RULE = "=" * 60
THIN_RULE = "-" * 60

# The system prompt, up to the glossary.
SYSTEM = """You are a digital forensics analyst specializing in deepfake video detection.

YOUR TASK: Analyze video frames AND automated metrics to determine if a video contains manipulated visual content (face-swap/reenactment), manipulated audio (voice cloning/TTS), or both.

EVIDENCE SOURCES (use BOTH, do not rely on only one):
1. VISUAL FRAMES — attached images from sampled chunks. Inspect them carefully for:
   - Face-background boundary: blending seams, color/lighting mismatch
   - Skin texture: unnatural smoothness, inconsistency across face regions
   - Eyes: reflection consistency, symmetry, natural movement
   - Temporal consistency: compare frames within and across chunks for flickering/morphing
   - Overall naturalness: does the face look photorealistic or synthetic?
2. AUTOMATED METRICS — per-chunk features compared against a genuine baseline.
   Each metric has a severity tag:
     CRITICAL = far into the suspicious direction
     ELEVATED = moderately suspicious
     NORMAL   = within genuine range
   For most features HIGH is suspicious, but some are suspicious when LOW (blinking_variance, mouth_movement_variance, iris_jitter_variance, vocal_jitter_relative, vocal_shimmer_relative) — see glossary.

CALIBRATION RULES:
- A single CRITICAL metric can be noise. Multiple CRITICAL in the SAME group is a strong signal.
- Genuine videos may show a few ELEVATED features — judge the whole picture.
- Visual inspection can catch artifacts that metrics miss, and vice versa.
- When evidence is weak or contradictory, lean toward UNCERTAIN.

"""
GLOSSARY_HEAD = "METRIC GLOSSARY (what each feature measures; direction stated explicitly)."

# The task and the format of the answer.
TASK = """TASK: Determine whether this video contains manipulated content.
You must assess video manipulation and audio manipulation SEPARATELY.

Follow these steps:

STEP 1 — VISUAL INSPECTION:
  Carefully examine the attached frames. For each chunk, describe:
  - Face quality: skin texture, boundary with background, blending artifacts
  - Eye region: reflections, symmetry, natural movement
  - Temporal consistency: do frames within/across chunks look consistent?
  - Any synthetic or unnatural appearance?

STEP 2 — METRIC REVIEW:
  Review ELEVATED and CRITICAL metrics across all chunks.
  - GROUP 1+2 anomalies suggest VIDEO manipulation (face-swap, reenactment)
  - GROUP 3 anomalies suggest lip-sync mismatch or dubbed audio
  - GROUP 4 anomalies suggest AUDIO manipulation (voice cloning, TTS)

STEP 3 — CROSS-REFERENCE:
  Do visual findings agree with metrics? For example:
  - Visual blending artifacts + CRITICAL blending metrics = strong face-swap signal
  - Frames look natural but metrics are CRITICAL = possible subtle manipulation
  - Frames look synthetic but metrics are NORMAL = metrics may have missed it

STEP 4 — SEPARATE ASSESSMENT:
  Based on all evidence, determine independently:
  a) Is the VIDEO (visual) manipulated? (face-swap, reenactment, synthesis)
  b) Is the AUDIO manipulated? (voice cloning, TTS, dubbed)

STEP 5 — FINAL VERDICT:
  - If either video or audio is manipulated → overall label is FAKE
  - If neither is manipulated → GENUINE
  - If unsure → UNCERTAIN

Respond in EXACTLY this format:

<verdict>
{
  "video_fake": true or false,
  "audio_fake": true or false,
  "label": "GENUINE | FAKE | UNCERTAIN",
  "confidence": "LOW | MEDIUM | HIGH",
  "video_manipulation_type": "FACE_SWAP | REENACTMENT | NONE | UNCERTAIN",
  "audio_manipulation_type": "VOICE_CLONING | TTS | DUBBED | NONE | UNCERTAIN",
  "primary_evidence": ["brief description of key evidence"],
  "visual_inspection_summary": "what you observed in the frames",
  "metric_summary": "key metric findings",
  "key_reasoning": "1-2 sentence overall justification"
}
</verdict>"""
NO_CHUNKS = "NOTE: No valid chunks were extracted for this video. Answer UNCERTAIN with LOW confidence."


def glossary() -> str:
    groups = ["\n".join([f"\n{group}", *(f"  - {name}: {text}" for name, text in names.items())]) for group, names in GLOSSARY.items()]
    return "\n".join([GLOSSARY_HEAD, *groups])


def system_prompt() -> str:
    return SYSTEM + glossary()
