"""Fixed values the results depend on.  Everything here is a default parameter."""

# --- fixed values: categories kept from the raw log ---------------------------------
LOG_CATEGORIES = ("UNDO", "Menu", "Tool")
LOW_LEVEL = "UNDO"
HIGH_LEVEL = ("Tool", "Menu")
WORKFLOW = "workflow"

# --- fixed values: message prefixes that are noise ----------------------------------
NOISE_PREFIXES = (
    "DestroyEvent: ",
    "Begin Internal Event: ",
    "Event:",
    "Event name changed from ",
    "Beta Undo Alert",
    "Undo Problem:",
    "Abort Event: ",
    "Menu: Undo",
    "Menu: Redo",
)

# --- fixed values: message suffixes that are noise (view changes and the like) ------
NOISE_SUFFIXES = (
    "(242)",
    "(-242)",
    "(218)",
    "(199)",
    "(236)",
    "(-241)",
    "(-240)",
    "(307)",
    "End Event: Select Similar: Undo not pos (166)",
    "End Event: Fit To Objects (166)",
    "(201)",
    "(-303)",
    "(305)",
    "(306)",
    "(193)",
    "(8)",
    "(205)",
    "(203)",
)
# The live path keeps rows ending in this suffix.
BATCH_ONLY_SUFFIX = "(-303)"
# Suffixes that also remove menu rows; empty, so it removes nothing.
MENU_NOISE_SUFFIXES: tuple[str, ...] = ()

# --- fixed values: exact messages the live path drops -------------------------------
NOISE_MESSAGES = (
    "End Event: Plug-in Event (166)",
    "End Event:  (1)",
    "End Event:  (166)",
    "End Event: ()",
    "End Event: Zoom on objects (166)",
    "End Event: Zoom on objects (-1)",
    "Menu: Undo -  (-26) (0)",
    "Menu: Redo -  (-180) (0)",
)

# --- fixed values: low-level events too generic to be part of a pair ----------------
GENERIC_EVENTS = (
    "End Event: Shape Pane Edit (89)",
    "End Event: Delete (58)",
    "End Event: Drag (75)",
    "End Event: Set Active Layer (32)",
    "End Event: Resize (146)",
)

# --- fixed values: workflows, comma separated ---------------------------------------
WORKFLOWS = (
    "Tool: Rectangle,End Event: Change Attributes",
    "Tool: Line,End Event: Delete,Tool: Line",
    "Tool: Line,Tool: Move by Points",
    "Tool: Rectangle,Menu: Add Surface - ",
    "Tool: Rectangle,Menu: Extrude and Edit - ",
    "Tool: 2D Polygon,End Event: Change Attributes",
    "Menu: Save As - ,Menu: Export PDF - ",
    "Menu: Duplicate - ,End Event: Drag,End Event: Modify Text",
    "Menu: Copy - ,End Event: Set Active Layer,Menu: Paste - ",
    "Tool: Mirror,End Event: Drag,End Event: Resize",
)

# --- fixed values: thresholds -------------------------------------------------------
PAIR_MIN_CONFIDENCE = 0.1
PAIR_RARE_SUPPORT = 1300
PAIR_RARE_CONFIDENCE = 0.4
GROUP_SIMILARITY = 0.82
RESERVED_CODES = 3
RESERVED_WEIGHT = 1e-8
MAX_LIST_LENGTH = 200
MIN_SESSION_LENGTH = 5
NO_PREDICTION = "No enough data for inference!"


def workflow_patterns(workflows=WORKFLOWS) -> list[list[str]]:
    """Each workflow as the list of its parts."""
    return [text.split(",") for text in workflows]
