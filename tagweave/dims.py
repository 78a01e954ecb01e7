"""Fixed values of the domain: they decide results and are listed plainly."""

from __future__ import annotations

# Meanings of the letters of an instrument's function code.
LETTER_MEANINGS = {
    "A": "Analysis", "B": "Burner/Combustion", "C": "Conductivity/Control", "D": "Density", "E": "Voltage/Element", "F": "Flow",
    "G": "Gauging", "H": "Hand", "I": "Current/Indicate", "J": "Power", "K": "Time/Schedule", "L": "Level", "M": "Moisture",
    "N": "User's Choice", "O": "Orifice", "P": "Pressure", "Q": "Quantity", "R": "Radiation/Record", "S": "Speed/Switch",
    "T": "Temperature/Transmit", "U": "Multivariable", "V": "Vibration/Valve", "W": "Weight/Well", "X": "Unclassified",
    "Y": "Event/Relay", "Z": "Position/Driver",
}

# Function codes that drawings use.
KNOWN_CODES = [
    "AOV", "BDV", "MOV", "SDV", "XV", "FCV", "PCV", "TCV", "LCV", "HCV", "PSV", "RO",
    "SV", "SVO", "SVC", "ZSO", "ZSC", "ZS", "ZT", "ZI", "ZY",
    "PT", "PIT", "PDT", "PDIT", "PI", "PG", "PSH", "PSL", "PSHH", "PSLL",
    "TT", "TIT", "TE", "TW", "TI", "TSH", "TSL",
    "FT", "FIT", "FE", "FI", "FQ", "FQI", "FY", "FS",
    "LT", "LIT", "LE", "LI", "LSH", "LSL", "LSHH", "LSLL", "LG",
    "AT", "AIT", "AE", "AI",
    "VT", "VE", "VI", "ST", "SE", "SI",
    "FIC", "PIC", "TIC", "LIC", "FFIC", "UIC",
    "PY", "TY", "LY", "AY", "UY", "KY",
    "HS", "HV", "XY", "XA", "UA", "KQI",
]

# Characters that are read for one another, in both directions.
CONFUSABLE = [
    ("O", "0"), ("O", "Q"), ("O", "D"), ("Q", "0"), ("I", "1"), ("I", "L"), ("1", "7"), ("1", "T"), ("S", "5"), ("B", "8"), ("Z", "2"), ("G", "6"),
    ("A", "4"), ("A", "7"), ("U", "V"), ("C", "G"), ("E", "F"), ("9", "3"), ("6", "5"),
]

# Accepted names of columns, lower case without separators; the first that has a value wins.
SEED_ALIASES = {
    "tag": ["tag", "tagnumber", "tagno"],
    "isa_function": ["isafunction", "function", "functiondescription"],
    "description": ["description", "servicedescription"],
    "loop_group": ["loopgroup", "loop", "group"],
    "line_or_equipment": ["lineorequipment", "line", "equipment", "lineequipment"],
    "panel": ["panel", "controlpanel"],
    "size": ["size", "nominalsize"],
    "fail_position": ["failposition", "failsafe", "failaction"],
    "notes": ["notes", "note", "comment", "comments"],
    "state": ["reviewstate", "state", "confidence", "verified"],
}
LINE_ALIASES = {
    "line_number": ["linenumber", "line", "lineno"],
    "size": ["size", "nominalsize"],
    "service": ["service", "fluid", "commodity"],
    "spec_code": ["speccode", "spec", "pipingspec"],
    "from_ref": ["fromref", "from", "origin"],
    "to_ref": ["toref", "to", "destination"],
    "notes": ["notes", "note", "comment", "comments"],
}

# Export headers, and the column of a tag that each shows.
TAG_HEADERS = {
    "Tag": "text", "ISA_Function": "isa_function", "Description": "description", "Loop_Group": "loop_group", "Line_or_Equipment": "line_or_equipment",
    "Panel": "panel", "Size": "size", "Fail_Position": "fail_position", "Notes": "notes", "Review_State": "state", "Function_Code": "function_code",
    "Loop_Number": "loop_number", "Suffix": "suffix", "Type": "type", "Source": "source", "Origin": "origin", "Continues_On": "continues_on",
    "Page": "page", "Confidence_%": "confidence", "Center_X": None, "Center_Y": None, "Width": None, "Height": None, "Updated_At": "updated_at", "Updated_By": "updated_by",
}
LINE_HEADERS = {"Line_Number": "line_number", "Size": "size", "Service": "service", "Spec_Code": "spec_code", "From": "from_ref", "To": "to_ref", "Notes": "notes"}
NOTE_HEADERS = {"Flag": "flag", "Note": "text"}
META_LABELS = {
    "drawing_number": "Drawing Number", "revision": "Revision", "title": "Title", "project": "Project", "client": "Client", "county": "County/Parish",
    "state": "State", "date": "Date", "match_line_refs": "Match Line References", "source_file_name": "Source File",
}
STATES = ("uncertain", "confirmed", "illegible")
UPLOAD_TYPES = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp")
# Colours of boxes on exported pages, and the characters that a circle's tag may hold.
EXPORT_COLOURS = {"confirmed": "#16a34a", "uncertain": "#f59e0b", "illegible": "#dc2626"}
TAG_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-"
