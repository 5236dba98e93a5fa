"""Row shapes shared by sources and operators."""

#: Alignment records. pos and mate_pos count from 0; qual is raw phred (255 where the file has none);
#: seq is NULL or '' where the file has none; ord is the order in the file, used for tie-breaks alone.
READS = (
    "qname string, flag int, tid int, ref string, pos bigint, mapq int, cigar array<struct<len:int,op:string>>, "
    "mate_tid int, mate_pos bigint, tlen bigint, seq string, qual array<int>, ord bigint"
)
#: Contigs in header order; tid is that order.
CONTIGS = "tid int, ref string, length bigint"
#: Half-open intervals that count from 0. rid tells regions apart, equal ones too.
REGIONS = "rid bigint, tid int, ref string, start bigint, stop bigint"

#: Output columns, in the order in which files have them.
RANGES = ["REF", "POS", "END", "DEPTH"]
BED_RANGES = ["chrom", "chromStart", "chromEnd", "name", "score"]
COUNTS = ["DEPTH", "A", "C", "G", "T", "N", "R", "Y", "S", "W", "K", "M", "INS", "DEL", "REF_SKIP", "FAIL", "COUNT_OF_MATE_RESOLUTIONS"]
PILEUP = ["REF", "POS", "REF_BASE", *COUNTS, "NEAR_MAX_DEPTH"]

#: Reference bases per row of the look-up table: a power of two.
PIECE_BITS = 16
