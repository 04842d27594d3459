"""Table layouts of known tools: recognised by their headers; they say which columns to pin, put first, hide or colour."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Layout:
    """A known tool's table. required, pinned, first and hidden are column names; color is the column that colours rows."""

    name: str
    required: tuple[str, ...]
    pinned: tuple[str, ...] = ()
    first: tuple[str, ...] = ()
    hidden: tuple[str, ...] = ()
    color: str | None = None

    def order(self, columns: Sequence[str]) -> list[str]:
        """The columns to show, in order: pinned, first, then the others as they come, without the hidden ones."""
        lead = [c for c in (*self.pinned, *self.first) if c in columns]
        return lead + [c for c in columns if c not in lead and c not in self.hidden]


# Name | required headers | pinned | first | hidden | colour. The jump-list headers that tell it from the
# shortcut table are AppId and DestListVersion. The last two rows are the tables that this library's own readers make.
_TABLE = """
MFTECmd | EntryNumber, ParentEntryNumber, InUse | FileName, ParentPath, Extension | FileSize, Created0x10, LastModified0x10, IsDirectory | EntryNumber, SequenceNumber, ReferenceCount, ReparseTarget | Extension
EvtxECmd | PayloadData1, Channel, Provider | TimeCreated, EventId, Channel | Computer, PayloadData1, PayloadData2, PayloadData3 | ChunkNumber, Keywords, Opcode, RecordNumber | Channel
PECmd (Prefetch) | ExecutableName, RunCount, SourceFilename | ExecutableName, RunCount | LastRun, PreviousRun0, PreviousRun1, PreviousRun2, PreviousRun3, PreviousRun4, PreviousRun5, PreviousRun6, SourceFilename, Volume | | ExecutableName
LECmd (LNK Files) | SourceFile, TargetPath, Arguments | SourceFile, TargetPath | Arguments, WorkingDirectory, CreatedOn, ModifiedOn | | TargetPath
AmcacheParser (Files) | ProgramId, SHA1, FullPath | FullPath, SHA1 | FileSize, CompileTime, BinaryType, Publisher | |
AmcacheParser (Programs) | ProgramId, Name, Publisher, InstallDate | Name, Version | Publisher, InstallDate, UninstallString | |
RECmd (Registry) | HivePath, Key, ValueName, ValueData | HivePath, Key, ValueName | ValueData, LastWriteTimestamp, ValueType | | HivePath
SBECmd (ShellBags) | AbsolutePath, ShellType | AbsolutePath, ShellType | LastWriteTime, MFTEntry, CreatedOn | |
SrumECmd (SRUM) | ExeInfo, AppId | ExeInfo, AppId | Timestamp, NetworkUsage, ForegroundTime | |
AppCompatcache (Shimcache) | ControlSet, CacheEntryPosition, Path | Path, LastModifiedTime | Executed, CacheEntryPosition | |
JLECmd (Jump Lists) | SourceFile, AppId, DestListVersion | FileName, TargetPath | Arguments, CreatedOn, ModifiedOn | |
ForensicTimeline | datetime, timestamp_desc, source, sourcetype | datetime, source, sourcetype | timestamp_desc, message, filename, display_name | | source
Plaso SuperTimeline | datetime, source, sourcetype, type, display_name | datetime, source, type | sourcetype, display_name, message, filename | | source
MacTime (Bodyfile) | Date, Size, Type, Mode, File Name | Date, File Name, Type | Size, Mode, UID, GID | |
KapeMiniTimeline | Date, Time, Source, Short, Desc | Date, Time, Source | Type, Short, Desc | | Source
PsortTimeline (Plaso) | Timestamp, TimestampDescription, Source, SourceLong | Timestamp, Source | TimestampDescription, SourceLong | | Source
Hayabusa (Standard) | Timestamp, RuleTitle, Level, Computer | Timestamp, RuleTitle, Level | Computer, Channel, RuleFile | | Level
Hayabusa (Verbose) | Timestamp, RuleTitle, Level, Details, ExtraFieldInfo | Timestamp, RuleTitle, Level | Details, ExtraFieldInfo, Computer | | Level
Chainsaw (Logons) | system_time, id, workstation_name, target_username, source_ip, logon_type | system_time, target_username | source_ip, logon_type, workstation_name | | logon_type
Chainsaw (Command Line Hunt) | system_time, id, detection_rules, Event.EventData.CommandLine, process_name | system_time, detection_rules | Event.EventData.CommandLine, process_name, computer_name | | detection_rules
Chainsaw (Process Creation Hunt) | system_time, id, detection_rules, Event.EventData.Image, command_line | system_time, detection_rules | Event.EventData.Image, command_line, computer_name | | detection_rules
Chainsaw (Registry Hunt) | system_time, id, detection_rules, Event.EventData.Details, target_object | system_time, detection_rules | Event.EventData.Details, target_object, computer_name | | detection_rules
Chainsaw (File Creation Hunt) | system_time, id, detection_rules, Event.EventData.TargetFilename, image | system_time, detection_rules | Event.EventData.TargetFilename, image, computer_name | | detection_rules
Chainsaw (Sigma) | Timestamp, RuleTitle, Level, Channel, MitreTactics | Timestamp, RuleTitle, Level | Channel, MitreTactics | | Level
BrowsingHistoryView | URL, Title, Visit Time, Web Browser | Visit Time, URL, Title | Web Browser, Visit Count, Visit Type | | Web Browser
KAPE Copy Log | CopiedTimestamp, SourceFile, DestinationFile, SourceFileSha1 | CopiedTimestamp, SourceFile | DestinationFile, SourceFileSha1 | |
Native event log | datetime, RecordId, EventID, Provider, Level, Channel | datetime, EventID, Channel | Computer, Message | | Channel
Change journal | Name, EntryNumber, UpdateSequenceNumber, UpdateReasons | UpdateTimestamp, Name | UpdateReasons, ParentPath | | UpdateReasons
"""


def _layouts() -> tuple[Layout, ...]:
    out = []
    for line in _TABLE.strip().splitlines():
        name, *lists, color = (x.strip() for x in line.split("|"))
        out.append(Layout(name, *(tuple(filter(None, (x.strip() for x in cells.split(",")))) for cells in lists), color or None))
    return tuple(out)


LAYOUTS = _layouts()


def detect_layout(columns: Sequence[str], layouts: Sequence[Layout] = LAYOUTS) -> Layout | None:
    """The layout with the most required headers among those whose headers are all there; ties go to the first."""
    held = set(columns)
    fit = [x for x in layouts if held.issuperset(x.required)]
    return max(fit, key=lambda x: len(x.required), default=None)
